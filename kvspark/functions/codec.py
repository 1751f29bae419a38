"""Keys as bytes: ordering of prefixes and of unsigned integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def prefix_range(key: Column, prefix: bytes) -> Column:
    """Keys with this prefix, as a range: ranges reach the Parquet scan, startswith does not."""
    end = successor(prefix)
    found = key >= F.lit(prefix)
    return found if end is None else found & (key < F.lit(end))


def u64_bytes(n: int) -> bytes:
    return n.to_bytes(8, "big")


def encode_u64(n: Column) -> Column:
    """Eight big-endian bytes, so that byte order is number order."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def decode_u64(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10).cast("decimal(20,0)")


def text(key: Column) -> Column:
    return F.decode(key, "UTF-8")
