"""Mutation logs: (key, value, op, seq) with op ``put`` or ``del``, later seq wins.

The rank filter runs on both sides of the shuffle, so a key with many mutations sends one row
from each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions


def latest(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fold(log: DataFrame, committed: Column | None = None, before: int | None = None) -> DataFrame:
    """The bucket a log leaves: without the transactions that are not committed, and as it was
    before a seq, if asked for."""
    if committed is not None:
        log = log.where(committed)
    if before is not None:
        log = log.where(F.col("seq") < before)
    return puts(latest(log))


def puts(log: DataFrame) -> DataFrame:
    """The bucket that a log with a row a key makes of an empty one."""
    return log.where("op = 'put'").select("key", "value")


def overlay(base: DataFrame, changed: DataFrame, keys: DataFrame, small: bool = False) -> DataFrame:
    """A bucket after mutations (a row a key) that come later than all of its rows. keys: theirs, repeated
    or not. The bucket's rows move only if these are not small, that is, can't be sent to every task."""
    old = base.select("key", "value").join(F.broadcast(keys) if small else keys, "key", "left_anti")
    return old.unionByName(puts(changed))


def remove(b: DataFrame, keys: DataFrame) -> DataFrame:
    return b.join(keys.select("key"), "key", "left_anti")


def sequences(log: DataFrame) -> DataFrame:
    """log (bucket, seq) with id, the number that the bucket's counter gives the row: positions
    in (bucket, seq) order, less the sizes of the buckets before."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = log.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = positions(log.select("bucket", "seq"), "bucket", "seq")
    return placed.join(starts, "bucket").select("bucket", "seq", (F.col("pos") - F.col("start")).alias("id"))


def sequence(log: DataFrame) -> DataFrame:
    """The counter of each bucket after the log."""
    return log.groupBy("bucket").agg(F.count("*").alias("sequence"))
