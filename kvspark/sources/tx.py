"""Transactions and buckets.

Writes are buffered: single puts and removes in a dictionary, bulk writes as DataFrames, in order.
Reads in the transaction see the snapshot overlaid with the buffer. A commit writes, for each
changed bucket, a delta of its mutations, a row a key, sorted by key; then it publishes one version
with all of them. Once a bucket has many deltas, a commit merges the newest ones of about equal size,
and takes in the bucket's other rows only when the deltas are a good share of them. So what is
written follows what is changed.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    KEY_LIMIT,
    VALUE_LIMIT,
    BucketExists,
    BucketNotFound,
    KeyNotFound,
    KeyTooLarge,
    TxClosed,
    ValueTooLarge,
    WriteInReadTransaction,
    check_key,
    check_value,
)
from ..operators import fold, scan, stats
from .cursor import Cursor
from .manifest import BucketEntry, Manifest

ROW = "key binary, value binary"
LOG = "key binary, value binary, op string"
#: Bytes of keys that a join sends to every task at most. Deltas merge with one before them that is at
#: most so many times their size. Bytes that a row takes in a sort besides its key and value.
_BROADCAST, _TIER, _ROW = 64 << 20, 4, 64
_MOST_SEQUENCE = (1 << 63) - 1


class Bucket:
    def __init__(self, tx: Tx, name: bytes, entry: BucketEntry):
        self.tx, self.name, self.entry = tx, name, entry
        self.sequence_now = entry.sequence
        self._single: dict[bytes, bytes | None] = {}  # None: removed
        self._bulk: list[DataFrame] = []  # logs, in order, before the single ones
        self._bulk_bytes = 0  # as a sort holds them

    # Reads

    @property
    def df(self) -> DataFrame:
        """All rows, as this transaction sees them."""
        self.tx._open()
        if self._first():
            return fold.puts(self._bulk[0])
        base, logs = self._stored(), self._logs()
        small = not self._bulk and (sum(self.entry.delta_rows) + len(self._single)) * KEY_LIMIT <= _BROADCAST
        return fold.overlay(base, _merged(logs), _keys(logs), small) if logs else base

    def _first(self) -> bool:
        """All that there is came in one bulk write: unique keys, nothing to fold."""
        return not self.entry.folders() and len(self._bulk) == 1 and not self._single

    def _stored(self) -> DataFrame:
        spark, entry = self.tx.store.spark, self.entry
        return self._base(entry.base) if entry.base else spark.createDataFrame([], ROW)

    def _delta(self, folder: str) -> DataFrame:
        return self.tx.store.spark.read.schema(LOG).parquet(self.tx._at(folder))

    def _logs(self, single: bool = True) -> list[DataFrame]:
        """Mutations in order, each with one row a key."""
        logs = [*map(self._delta, self.entry.deltas), *self._bulk]
        return [*logs, self._single_log()] if single and self._single else logs

    def _single_log(self) -> DataFrame:
        rows = [(bytearray(k), bytearray(v or b""), "del" if v is None else "put") for k, v in self._single.items()]
        return self.tx.store.spark.createDataFrame(rows, LOG)

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        self.tx._open()
        if key in self._single:
            value = self._single[key]
            return value, value is not None
        # From the newest log back, each read by key alone; what was put one by one is not there.
        logs = self._logs(single=False)
        found = _merged([scan.get(log, key) for log in logs]).head() if logs else None
        if found is None:
            found = scan.get(self._stored(), key).withColumn("op", F.lit("put")).head()
        return (bytes(found.value), True) if found and found.op == "put" else (None, False)

    def multi_get(self, requests: DataFrame) -> DataFrame:
        return scan.multi_get(self.df, requests)

    def range(self, begin: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return scan.key_range(self.df, begin, end)

    def prefix(self, start: bytes) -> DataFrame:
        return scan.prefix(self.df, start)

    def cursor(self) -> Cursor:
        return Cursor(lambda: self.df)

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        """In key order, a partition at a time."""
        for row in self.df.orderBy("key").toLocalIterator():
            yield bytes(row.key), bytes(row.value)

    def for_each(self, f: Callable[[bytes, bytes], object]) -> None:
        """In key order; what f raises ends it and goes to the caller."""
        for key, value in self.items():
            f(key, value)

    def sequence(self) -> int:
        self.tx._open()
        return self.sequence_now

    def stat(self) -> dict:
        return stats.bucket_stat(self.df).head().asDict()

    # Writes

    def put(self, key: bytes, value: bytes) -> None:
        self.tx._writable()
        check_key(key)
        check_value(value)
        self._single[bytes(key)] = bytes(value)
        self.tx._touch(self)

    def remove(self, key: bytes) -> None:
        self.tx._writable()
        if not self.get(key)[1]:
            raise KeyNotFound(repr(key))
        self._single[bytes(key)] = None
        self.tx._touch(self)

    def remove_many(self, keys: Iterable[bytes]) -> None:
        """As remove, for all of the keys at once: they are looked up together."""
        self.tx._writable()
        asked = {bytes(k) for k in keys}
        rows = self.tx.store.spark.createDataFrame([(bytearray(k),) for k in asked], "key binary")
        held = {bytes(r.key) for r in self.df.select("key").join(F.broadcast(rows), "key", "left_semi").collect()}  # some of the keys asked for
        if asked - held:
            raise KeyNotFound(repr(min(asked - held)))
        self._single |= dict.fromkeys(asked)
        self.tx._touch(self)

    def put_df(self, rows: DataFrame) -> None:
        """(key, value), unique keys. One pass checks sizes, nulls and repeated keys."""
        self.apply_df(rows.select("key", "value", F.lit("put").alias("op")))

    def apply_df(self, log: DataFrame) -> None:
        """(key, value, op), unique keys: puts, and removes (op ``del``) of keys that may not be there. Checked
        as in put_df."""
        self.tx._writable()
        gone = F.col("op") == "del"
        log = log.select(F.col("key").cast("binary").alias("key"), F.when(gone, F.lit(b"")).otherwise(F.col("value").cast("binary")).alias("value"), "op")
        found = _sizes(log).head()
        _check(found)
        if found.rows:
            self._add(log, found.bytes + found.rows * _ROW)

    def remove_df(self, keys: DataFrame) -> None:
        """Keys that are not there are passed over."""
        self.tx._writable()
        keys = keys.select(F.col("key").cast("binary").alias("key")).distinct()
        found = keys.agg(F.sum(F.octet_length("key").cast("long")).alias("bytes"), F.count("*").alias("rows")).head()
        if found.bytes is not None:
            self._add(keys.select("key", F.lit(b"").alias("value"), F.lit("del").alias("op")), found.bytes + found.rows * _ROW)

    def _add(self, log: DataFrame, size: int) -> None:
        if self._single:
            self._bulk.append(self._single_log())
            self._bulk_bytes += self._single_bytes()
            self._single = {}
        self._bulk.append(log)
        self._bulk_bytes += size
        self.tx._touch(self)

    def _single_bytes(self) -> int:
        return sum(len(k) + len(v or b"") + _ROW for k, v in self._single.items())

    def next_sequence(self, n: int = 1) -> int:
        """The next number, the first of n if more are taken at once."""
        self.tx._writable()
        if self.sequence_now + n > _MOST_SEQUENCE:
            raise OverflowError("sequence")
        self.sequence_now += n
        self.tx._touch(self)
        return self.sequence_now - n + 1

    # Commit

    def _write(self) -> BucketEntry:
        """Write what changed; the entry for the next version."""
        entry = BucketEntry(**{**self.entry.__dict__, "sequence": self.sequence_now})
        if not self._bulk and not self._single:
            return entry
        size = self._bulk_bytes + self._single_bytes()
        if self._first():
            base = self._store(fold.puts(self._bulk[0]), size)
            return replace(entry, base=base, **stats.bucket_stat(self._base(base)).head().asDict())
        logs = [*self._bulk, *([self._single_log()] if self._single else [])]
        folder = self._store(_merged(logs).select("key", "value", "op"), size)
        log = self._delta(folder)
        # The counters change by the rows of the touched keys only.
        now = log.agg(F.count("*").alias("n"), *stats.counters(F.col("op") == "put")).head().asDict()
        n = now.pop("n")
        before = Bucket(self.tx, self.name, entry).df
        keys = log.select("key")
        gone = stats.bucket_stat(before.join(F.broadcast(keys) if n * KEY_LIMIT <= _BROADCAST else keys, "key", "left_semi")).head().asDict()
        counts = {k: getattr(entry, k) - gone[k] + v for k, v in now.items()}
        return self._compacted(replace(entry, deltas=(*entry.deltas, folder), delta_rows=(*entry.delta_rows, n), **counts))

    def _compacted(self, entry: BucketEntry) -> BucketEntry:
        options, size = self.tx.store.options, self.tx.store._size
        if len(entry.deltas) <= options.compact_after:
            return entry
        sizes = [size(d) for d in entry.deltas]
        k = len(sizes) - 1
        while k and sizes[k - 1] <= _TIER * sum(sizes[k:]):
            k -= 1
        base = size(entry.base) if entry.base else 0
        if not k and sum(sizes) >= options.rewrite_share * base:
            rows = Bucket(self.tx, self.name, entry).df
            return replace(entry, base=self._store(rows, entry.bytes_in_use + entry.items_n * _ROW), deltas=(), delta_rows=())
        if k == len(sizes) - 1:
            return entry
        newest = [self._delta(d) for d in entry.deltas[k:]]
        most = sum(log.agg(stats.counters()[-1]).head()[0] for log in newest) + sum(entry.delta_rows[k:]) * _ROW
        folder = self._store(_merged(newest).select("key", "value", "op"), most)
        return replace(entry, deltas=(*entry.deltas[:k], folder), delta_rows=(*entry.delta_rows[:k], self._delta(folder).count()))

    def _store(self, rows: DataFrame, size: int) -> str:
        """Write rows that take so many bytes in a sort, at most, sorted by key; the folder."""
        folder = self.tx._folder()
        self.tx._sorted(rows, size, "key").parquet(self.tx._at(folder))
        return folder

    def _base(self, folder: str) -> DataFrame:
        return self.tx.store.spark.read.schema(ROW).parquet(self.tx._at(folder))


def _merged(logs: list[DataFrame]) -> DataFrame:
    """The last mutation of each key; each log has a row a key."""
    if len(logs) == 1:
        return logs[0]
    log = logs[0].select("key", "value", "op", F.lit(0).alias("seq"))
    for k, more in enumerate(logs[1:], 1):
        log = log.unionByName(more.select("key", "value", "op", F.lit(k).alias("seq")))
    return fold.latest(log).drop("seq")


def _keys(logs: list[DataFrame]) -> DataFrame:
    """The keys that logs change, some repeated."""
    keys = logs[0].select("key")
    for more in logs[1:]:
        keys = keys.unionByName(more.select("key"))
    return keys


def _sizes(log: DataFrame, *by: str) -> DataFrame:
    """What _check looks at, of (key, value, op): a row, or one for each group."""
    size = F.octet_length("key").cast("long") + F.octet_length("value")
    wrong = F.col("value").isNull() | F.coalesce(~F.col("op").isin("put", "del"), F.lit(True))
    each = log.groupBy(*by, "key").agg(F.count("*").alias("n"), F.max(F.octet_length("value")).alias("v"), F.count(F.when(wrong, 1)).alias("wrong"), F.sum(size).alias("bytes"))
    return each.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.octet_length("key")).alias("k"), F.max("v").alias("v"), F.sum(F.col("wrong") + F.col("key").isNull().cast("int")).alias("wrong"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")
    )


def _check(found) -> None:
    if found.wrong:
        raise ValueError("null keys or values, or an op that is neither put nor del")
    if (found.k or 0) >= KEY_LIMIT:
        raise KeyTooLarge(f"{found.k} bytes")
    if (found.v or 0) >= VALUE_LIMIT:
        raise ValueTooLarge(f"{found.v} bytes")
    if (found.n or 0) > 1:
        raise ValueError("repeated keys have no order; fold them first")


class Tx:
    def __init__(self, store, snapshot: Manifest, write: bool):
        self.store, self.snapshot, self.write = store, snapshot, write
        self.closed = False
        self._handles: dict[bytes, Bucket] = {}
        self._entries = dict(snapshot.buckets)
        self._dirty: set[bytes] = set()
        self._folders: list[str] = []
        self._catalog_changed = False

    def _open(self) -> None:
        if self.closed:
            raise TxClosed()

    def _writable(self) -> None:
        self._open()
        if not self.write:
            raise WriteInReadTransaction()

    def _at(self, folder: str) -> str:
        return os.path.join(self.store.path, folder)

    def _folder(self) -> str:
        self._folders.append(f"data/{uuid.uuid4().hex}")
        return self._folders[-1]

    def _sorted(self, rows: DataFrame, size: int, *by: str):
        """A writer of rows in order, in files of bounded size. A single part is made behind an exchange: as a
        narrow step it would run all that comes before in one task."""
        options = self.store.options
        parts = max(1, math.ceil(size / options.file_bytes))
        rows = rows.repartitionByRange(parts, *by) if parts > 1 else rows.repartition(1)
        return rows.sortWithinPartitions(*by).write.option("maxRecordsPerFile", options.file_rows)

    def _touch(self, bucket: Bucket) -> None:
        if self._handles.get(bucket.name) is not bucket:
            raise BucketNotFound(repr(bucket.name))  # deleted in this transaction
        self._dirty.add(bucket.name)

    def bucket(self, name: bytes) -> Bucket:
        """The one handle of this bucket in this transaction."""
        self._open()
        if name not in self._entries:
            raise BucketNotFound(repr(name))
        if name not in self._handles:
            self._handles[name] = Bucket(self, name, self._entries[name])
        return self._handles[name]

    def create_bucket(self, name: bytes) -> Bucket:
        self._writable()
        if name in self._entries:
            raise BucketExists(repr(name))
        check_key(name)
        self._entries[name] = BucketEntry(name.hex())
        self._catalog_changed = True
        return self.bucket(name)

    def create_bucket_if_missing(self, name: bytes) -> Bucket:
        self._writable()
        return self.bucket(name) if name in self._entries else self.create_bucket(name)

    def load_df(self, rows: DataFrame) -> None:
        """New buckets with their rows: (bucket, key, value), keys unique in each. However many buckets there
        are, one pass checks all of them as put_df does, and one writes them, at once. Files are cut by the
        number of rows, so buckets with rows of very different sizes are better loaded apart."""
        self._writable()
        rows = rows.select(*[F.col(c).cast("binary").alias(c) for c in ("bucket", "key", "value")])
        found = _sizes(rows.withColumn("op", F.lit("put")), "bucket").collect()  # a row a bucket
        for r in found:
            if r.bucket is None:
                raise ValueError("null names of buckets")
            _check(r)
            check_key(bytes(r.bucket))
            if bytes(r.bucket) in self._entries:
                raise BucketExists(repr(bytes(r.bucket)))
        if not found:
            return
        names = sorted(bytes(r.bucket) for r in found)
        numbers = self.store.spark.createDataFrame([(bytearray(n), k) for k, n in enumerate(names)], "bucket binary, _n int")
        placed = rows.join(F.broadcast(numbers), "bucket").select("_n", "key", "value")
        folder = self._folder()
        self._sorted(placed, sum(r.bytes + r.rows * _ROW for r in found), "_n", "key").partitionBy("_n").parquet(self._at(folder))
        counts = stats.bucket_stat(self.store.spark.read.schema(f"{ROW}, _n int").parquet(self._at(folder)), "_n").collect()  # a row a bucket
        for r in counts:
            name, base = names[r["_n"]], self._folder()
            os.rename(os.path.join(self._at(folder), f"_n={r['_n']}"), self._at(base))
            self._entries[name] = BucketEntry(name.hex(), base=base, items_n=r.items_n, blobs_n=r.blobs_n, bytes_in_use=r.bytes_in_use)
        self._catalog_changed = True

    def delete_bucket(self, name: bytes) -> None:
        """Wins over all that was done to the bucket before in this transaction."""
        self._writable()
        if name not in self._entries:
            raise KeyNotFound(repr(name))
        del self._entries[name]
        self._handles.pop(name, None)
        self._dirty.discard(name)
        self._catalog_changed = True

    def buckets(self) -> list[bytes]:
        """Names in order."""
        self._open()
        return sorted(self._entries)

    def catalog(self) -> DataFrame:
        """The buckets of the snapshot with their counters."""
        self._open()
        rows = [(bytearray(n), b.sequence, b.items_n, b.blobs_n, b.bytes_in_use) for n, b in sorted(self._entries.items())]
        return self.store.spark.createDataFrame(rows, "name binary, sequence long, items_n long, blobs_n long, bytes_in_use long")

    def commit(self) -> None:
        self._writable()
        try:
            if self._dirty or self._catalog_changed:
                made = dict(self._entries)
                for name in sorted(self._dirty):
                    made[name] = self._handles[name]._write()
                self._before_publish()
                self.store._publish(Manifest(self.snapshot.version + 1, made))
                needed = {f for entry in made.values() for f in entry.folders()}
                self._folders = [f for f in self._folders if f not in needed]
        finally:
            self._finish()

    def _before_publish(self) -> None:
        """A hook for tests of crashes."""

    def rollback(self) -> None:
        """Nothing happens after a commit."""
        if not self.closed:
            self._finish()

    def _finish(self) -> None:
        self.closed = True
        for folder in self._folders:
            shutil.rmtree(self._at(folder), ignore_errors=True)
        self.store._end(self)
