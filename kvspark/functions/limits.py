"""Sizes of keys and values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import KeyTooLarge, ValueTooLarge

#: Keys are shorter than the first, values shorter than the second; values longer
#: than the third count as blobs. A blob's first page holds the fourth, further pages the fifth.
KEY_LIMIT = 512
VALUE_LIMIT = 1 << 30
BLOB_OVER = 1024
BLOB_FIRST_PAGE = 4079
BLOB_NEXT_PAGE = 4087


def check_key(key: bytes) -> None:
    if len(key) >= KEY_LIMIT:
        raise KeyTooLarge(f"{len(key)} bytes")


def check_value(value: bytes) -> None:
    if len(value) >= VALUE_LIMIT:
        raise ValueTooLarge(f"{len(value)} bytes")


def blob_pages(value: Column) -> Column:
    """Pages that a value of this size takes (for reports only)."""
    size = F.octet_length(value)
    more = F.ceil((size - BLOB_FIRST_PAGE) / F.lit(float(BLOB_NEXT_PAGE)))
    return F.when(size <= BLOB_FIRST_PAGE, F.lit(1)).otherwise(1 + more).cast("long")
