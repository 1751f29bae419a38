"""Reads of a bucket, a DataFrame of key and value (binary). All are plain plans: predicates on
the key reach the Parquet scan, and only operators that promise an order sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefix_range
from .order import neighbours as _neighbours
from .order import positions

def _lit(key: bytes) -> Column:
    return F.lit(bytearray(key))


def get(b: DataFrame, key: bytes) -> DataFrame:
    """At most one row."""
    return b.where(F.col("key") == _lit(key))


def multi_get(b: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key) -> key, value, found: a row a request."""
    held = b.select("key", "value", F.lit(True).alias("found"))
    return requests.select("key").join(held, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def first(b: DataFrame) -> DataFrame:
    return b.orderBy("key").limit(1)


def last(b: DataFrame) -> DataFrame:
    return b.orderBy(F.desc("key")).limit(1)


def seek(b: DataFrame, key: bytes) -> DataFrame:
    """The first row at or after the key."""
    return first(b.where(F.col("key") >= _lit(key)))


def page_after(b: DataFrame, key: bytes | None, rows: int) -> DataFrame:
    """The next rows after the key, in order; from the first on if the key is None."""
    return (b if key is None else b.where(F.col("key") > _lit(key))).orderBy("key").limit(rows)


def page_before(b: DataFrame, key: bytes | None, rows: int) -> DataFrame:
    """The rows before the key, going back; from the last on if the key is None."""
    return (b if key is None else b.where(F.col("key") < _lit(key))).orderBy(F.desc("key")).limit(rows)


def key_range(b: DataFrame, begin: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """begin <= key < end; None leaves a side open."""
    b = b if begin is None else b.where(F.col("key") >= _lit(begin))
    return b if end is None else b.where(F.col("key") < _lit(end))


def prefix(b: DataFrame, start: bytes) -> DataFrame:
    return b.where(prefix_range(F.col("key"), start)) if start else b


def forward(b: DataFrame) -> DataFrame:
    """All rows with their position in key order."""
    return positions(b, "key")


def reverse(b: DataFrame, begin: bytes | None = None) -> DataFrame:
    """Rows at or before begin (all if None) with their position, going back."""
    return positions(b if begin is None else b.where(F.col("key") <= _lit(begin)), "key", descending=True)


def take(b: DataFrame, begin: bytes, rows: int) -> DataFrame:
    """The first rows at or after begin, with their position."""
    return positions(b.where(F.col("key") >= _lit(begin)).orderBy("key").limit(rows), "key")


def neighbours(b: DataFrame) -> DataFrame:
    """key, next_key, prev_key."""
    return _neighbours(b.select("key"), "key", "next_key", "prev_key")


def take_while(b: DataFrame, fails: Column) -> DataFrame:
    """The rows, with position, before the first one that fails: what a walk that stops there
    has seen. The failing key is found by one aggregate."""
    stop = b.where(fails).agg(F.min("key").alias("_stop"))
    seen = b.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("key") < F.col("_stop"))).drop("_stop")  # one row
    return positions(seen, "key")
