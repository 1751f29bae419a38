"""Mixing sources to target weights.

Each document gets a hash-random key. Inside a source, documents are ordered by that key; the
leading hex digits of the key cut the order into ranges, so prefix sums of token counts are
computed range by range and shifted by the sums of the ranges before. A source takes whole
epochs, then cuts its order at the exact rest of its budget.

Cases: null and empty texts have size 0; a null id counts as empty text in the key; null source is a
source of its own, last in order; repeated rows count as often as they occur (equal rows share a
key, a tie, and which of them is cut does not change the multiset of results); texts of any length
are read whole; an empty table gives no rows; sources of size 0 get target 0; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import positions
from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range of one source holds at most, on average, and digits that it takes at least.
RANGE_ROWS, LEAST_DIGITS = 100_000, 3


def targets(totals: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """(skey, source, source_size) -> (skey, source_size, target), one row a source.

    The level starts as if no source were full. The sources below it are full at their caps, what
    they leave raises the level of the others, and so on until no more are full: a sum over the
    sources each time, however many they are.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = positions(totals.select("skey", "source_size", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")), "none", "name")
    caps = placed.select(
        "skey",
        "source_size",
        F.element_at(cycle, ((F.col("pos") - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    caps = scratch.save(caps, "caps")
    pool = int((caps.agg(F.floor(F.sum("source_size") * F.lit(share))).head()[0]) or 0)
    level, full = 0.0, -1
    while True:
        below = F.col("cap").cast("double") / F.col("weight") < level
        n, held, rest = caps.agg(F.count(F.when(below, 1)), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0))).head()
        if n == full or not rest:
            break
        level, full = float(pool - held) / float(rest), n
    level = level if rest else math.inf
    return caps.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def spread(sized: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns that cut each source's order into pieces for one task each. Those are the ranges,
    unless equal rows overfill one: their place among themselves is free, so each task that read
    some of them is a piece of its own, between the pieces before and after their key."""
    over = sizes.where(F.col("rows") > 2 * RANGE_ROWS).select("range").distinct()
    keys = sized.join(F.broadcast(over), "range", "left_semi").groupBy("skey", "range", "mix_key").count().where(F.col("count") > RANGE_ROWS)
    # A key here stands for RANGE_ROWS rows at least.
    hot = keys.groupBy("range").agg(F.sort_array(F.collect_set("mix_key")).alias("hot"))
    if over.isEmpty() or hot.isEmpty():
        return sized, ["range"]
    last = F.element_at(F.filter("hot", lambda k: k <= F.col("mix_key")), -1)
    sized = sized.join(F.broadcast(hot), "range", "left").withColumn("after", F.when(F.element_at("hot", 1) <= F.col("mix_key"), last).otherwise(""))
    sized = sized.withColumn("after", F.coalesce("after", F.lit(""))).withColumn("own", F.col("after") != F.col("mix_key"))
    return sized.withColumn("piece", F.when(F.col("own"), 0).otherwise(F.col("slot"))).drop("hot"), ["range", "after", "own", "piece"]


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    range_digits: int | None = None,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, mix_key.

    weights: of the sources in code point order, repeating. share: of all sizes. range_digits:
    a source is cut into 16 ** range_digits ranges of keys; None: as many as the number of rows
    asks for, which changes no result. Only ids and counts are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    source = F.col(f"`{source_col}`").cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("skey"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), text)).alias("mix_key"),
        F.spark_partition_id().alias("slot"),
    )
    sized = scratch.save(sized, "sized")
    if range_digits is None:
        n, range_digits = sized.count(), LEAST_DIGITS
        while n > RANGE_ROWS * 16**range_digits:
            range_digits += 1
    sized = sized.withColumn("range", F.substring("mix_key", 1, range_digits))
    # All groupings combine on the map side, so a hot source adds a row a task and range.
    sizes = scratch.save(sized.groupBy("skey", "source", "range").agg(F.sum("size").alias("range_size"), F.count("*").alias("rows")), "ranges")
    totals = sizes.groupBy("skey", "source").agg(F.sum("range_size").alias("source_size"))
    aims = targets(totals, scratch, weights, share, max_epochs)
    sized, place = spread(sized, sizes)
    ranges = sized.groupBy("skey", *place).agg(F.sum("size").alias("range_size")) if len(place) > 1 else sizes
    earlier = Window.partitionBy("skey").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranges.withColumn("shift", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(aims, "skey")
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .select("skey", *place, "shift", "source_size", "target", "epochs", "rest")
    )
    inside = Window.partitionBy("skey", *place).orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("shift") - F.col("inside")))
    return (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(shifts, ["skey", *place])
        .select(
            F.col("id").alias(id_col),
            F.col("source").alias(source_col),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"),
            "mix_key",
        )
    )


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "mix_key")


#: DuckDB. {docs} is the table of documents.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS mix_key
  FROM {docs}
), totals AS (
  SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey, source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS pool FROM totals
), filled AS (
  SELECT *, CAST(pool - coalesce(sum(cap) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lv
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT skey, source_size, least(CAST(cap AS DOUBLE), max(lv) OVER () * weight) AS target FROM filled
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM aims
), placed AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.skey ORDER BY mix_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN budgets b ON s.skey = b.skey
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken, mix_key
FROM placed
"""
