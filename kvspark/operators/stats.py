"""Counters of buckets and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BLOB_OVER, KEY_LIMIT, blob_pages

def counters(of: Column | None = None) -> list:
    """Of the rows that of holds for, all if None."""
    own = F.lit(True) if of is None else of
    size = F.octet_length("key") + F.octet_length("value")
    return [
        F.count(F.when(own, 1)).alias("items_n"),
        F.count(F.when(own & (F.octet_length("value") > BLOB_OVER), 1)).alias("blobs_n"),
        F.coalesce(F.sum(F.when(own, size.cast("long"))), F.lit(0)).alias("bytes_in_use"),
    ]


def bucket_stat(b: DataFrame, *by: str) -> DataFrame:
    return b.groupBy(*by).agg(*counters())


def db_stat(b: DataFrame) -> DataFrame:
    """b: (bucket, key, value) of all buckets; summed bucket by bucket."""
    each = bucket_stat(b, "bucket")
    return each.agg(
        F.count("*").alias("buckets_n"),
        F.coalesce(F.sum("items_n"), F.lit(0)).alias("items_n"),
        F.coalesce(F.sum("bytes_in_use"), F.lit(0)).alias("bytes_in_use"),
    )


def blobs(b: DataFrame) -> DataFrame:
    """Blobs and the pages they take."""
    return b.where(F.octet_length("value") > BLOB_OVER).select("key", blob_pages(F.col("value")).alias("pages"))


def classify(b: DataFrame, probe: str = "value") -> DataFrame:
    """What a put would say of the probe as a key, and how it would store the value."""
    return b.select(
        "key",
        F.when(F.octet_length(probe) >= KEY_LIMIT, "key too large").otherwise("ok").alias("as_key"),
        F.when(F.octet_length("value") > BLOB_OVER, "blob").otherwise("inline").alias("as_value"),
    )
