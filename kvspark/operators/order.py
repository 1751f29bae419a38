"""Positions in a total order, without bringing the rows into one task.

Bounds taken from a bounded, hash-chosen sample of the keys cut the order into parts. A row's
position is its rank inside its part, shifted by the sizes of the parts before; sizes come from a
scan of the keys alone, one row a part, and are broadcast. Rows move once, to their part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each part.
OVERSAMPLE = 20


#: Bytes of a part, and parts at most: their bounds become one expression.
PART_BYTES, MOST_PARTS = 256 << 20, 2048


def _bounds(df: DataFrame, keys: list[str]) -> list[tuple]:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(MOST_PARTS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES))
    chosen = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(OVERSAMPLE * parts)
    return [tuple(r) for r in chosen.orderBy(*keys).collect()][OVERSAMPLE - 1 :: OVERSAMPLE][: parts - 1]


def _part(keys: list[str], bounds: list[tuple]) -> Column:
    """The number of bounds at or before the key, by binary search."""
    key = F.struct(*keys)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        bound = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, bounds[mid])])
        return F.when(key < bound, search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(bounds))


def positions(df: DataFrame, *keys: str, descending: bool = False, name: str = "pos") -> DataFrame:
    """df with the 1-based position of each row by its keys, which are not null."""
    names = list(keys)
    part = _part(names, _bounds(df, names))
    way = F.desc if descending else F.asc
    before = Window.orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sizes = df.select(part.alias("_part")).groupBy("_part").count()
    shifts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*[way(k) for k in names]))
    placed = df.withColumn("_part", part).withColumn("_rank", rank).join(F.broadcast(shifts), "_part")
    return placed.select((F.col("_shift") + F.col("_rank")).cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def neighbours(df: DataFrame, key: str, after: str, before: str) -> DataFrame:
    """df with the next and the previous key; keys are unique."""
    part = _part([key], _bounds(df, [key]))
    ends = df.select(key, part.alias("_part")).groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    parts = Window.orderBy("_part")  # a row a part
    ends = ends.select("_part", F.lead("_first").over(parts).alias("_after"), F.lag("_last").over(parts).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(key)
    near = df.withColumn("_part", part).withColumn(after, F.lead(key).over(inside)).withColumn(before, F.lag(key).over(inside))
    return near.join(F.broadcast(ends), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(after, "_after").alias(after), F.coalesce(before, "_before").alias(before)
    )
