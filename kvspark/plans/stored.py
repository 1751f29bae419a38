"""The store itself, over the driver's tables: rows go through transactions, are committed, and read
back by bucket, key and cursor.

A store is made once for each session and folder of tables, below the folder that all executors
share, and stays for later queries.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from ..sources import Bucket, Store
from .queries import _CTES, _binary, customer_bucket, document_buckets, event_log, orders_bucket, shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_OPEN: dict[tuple[str, str], Store] = {}


def query(sql: str):
    """Registers a query with its SQL, which may read the tables of the plain queries."""

    def add(f):
        used = [f"{n} AS ({s})" for n, s in _CTES.items() if n in sql]
        SQL[f.__name__] = f"WITH {', '.join(used)} {sql}" if used else sql
        QUERIES[f.__name__] = f
        return f

    return add


@atexit.register
def clear() -> None:
    """Close and remove the stores of this process."""
    while _OPEN:
        store = _OPEN.popitem()[1]
        store.close()
        shutil.rmtree(store.path, ignore_errors=True)


def folder(spark: SparkSession) -> str:
    """A new folder for a store, on a file system with links and locks that all executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="kvspark-store-")
    path = os.path.join(urlsplit(shared).path, f"store-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def filled(spark: SparkSession, d: str) -> Store:
    """Orders, customers and documents (a bucket a language), changed in later transactions."""
    known = (spark.sparkContext.applicationId, d)
    if known in _OPEN and not _OPEN[known].closed:
        return _OPEN[known]
    store = Store.open(spark, folder(spark))
    with store.update() as tx:
        tx.create_bucket(b"orders").put_df(orders_bucket(spark, d))
        tx.create_bucket(b"customer").put_df(customer_bucket(spark, d))
        docs = document_buckets(spark, d).where("bucket is not null and key is not null and value is not null")
        tx.load_df(docs.withColumn("bucket", _binary(F.concat(F.lit("doc-"), "bucket"))))
    with store.update() as tx:  # overwrites, and removes one segment
        customers = tx.bucket(b"customer")
        rows = customer_bucket(spark, d)
        customers.put_df(rows.where(F.col("value") == F.lit(b"MACHINERY")).withColumn("value", F.lit(b"CHANGED")))
        customers.remove_df(rows.where(F.col("value") == F.lit(b"BUILDING")).select("key"))
        customers.next_sequence(7)
    with store.update() as tx:
        tx.bucket(b"customer").put(b"Customer#new", b"NEW")
    dropped = store.begin(write=True)  # leaves nothing
    dropped.bucket(b"orders").put(b"0000000042", b"lost")
    dropped.delete_bucket(b"customer")
    dropped.rollback()
    _OPEN[known] = store
    return store


_CUSTOMER = (
    "(SELECT k, CASE WHEN v = 'MACHINERY' THEN 'CHANGED' ELSE v END AS v FROM b_cust WHERE v <> 'BUILDING' UNION ALL SELECT 'Customer#new', 'NEW') c"
)


def read(spark, d, bucket: bytes, f: Callable[[Bucket], object]):
    """f of the bucket, in a read transaction. Its rows stay readable until a vacuum."""
    with filled(spark, d).view() as tx:
        return f(tx.bucket(bucket))


@query("SELECT k, v FROM b_orders WHERE k = '0000000042'")
def store_get(spark, d):
    return shown(read(spark, d, b"orders", lambda b: b.range(b"0000000042", b"0000000042\x00")))


@query("SELECT k, v FROM b_orders WHERE k >= '0000000500' ORDER BY k LIMIT 1")
def store_seek(spark, d):
    key, value = read(spark, d, b"orders", lambda b: b.cursor().seek(b"0000000500"))
    return shown(spark.createDataFrame([] if key is None else [(bytearray(key), bytearray(value))], "key binary, value binary"))


@query("SELECT k, v FROM b_orders WHERE k >= '00000001' AND k < '00000002'")
def store_prefix(spark, d):
    return shown(read(spark, d, b"orders", lambda b: b.prefix(b"00000001")))


@query("SELECT k, v FROM b_orders WHERE k >= '0000000100' AND k < '0000000200'")
def store_range(spark, d):
    return shown(read(spark, d, b"orders", lambda b: b.range(b"0000000100", b"0000000200")))


@query("SELECT k, v, true AS found FROM b_orders")
def store_multi_get(spark, d):
    """Every key of the table is asked for."""
    return shown(read(spark, d, b"orders", lambda b: b.multi_get(orders_bucket(spark, d).select("key"))))


@query(f"SELECT k, v FROM {_CUSTOMER}")
def store_committed(spark, d):
    """What three commits and a rollback leave."""
    return shown(read(spark, d, b"customer", lambda b: b.df))


@query(f"SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM {_CUSTOMER}")
def store_scan(spark, d):
    return shown(order.positions(read(spark, d, b"customer", lambda b: b.df), "key"))


@query("SELECT k, v FROM b_cust")
def store_rollback(spark, d):
    """A transaction reads its own writes, and its rollback takes them back."""
    store = filled(spark, d)
    tx = store.begin(write=True)
    try:
        bucket = tx.create_bucket(b"scratch")
        bucket.put_df(customer_bucket(spark, d))
        own = bucket.df
    finally:
        tx.rollback()
    with store.view() as seen:
        assert b"scratch" not in seen.buckets()
    return shown(own)


@query("SELECT name, items_n, blobs_n, bytes_in_use, sequence FROM ("
       "SELECT 'orders' AS name, count(*) AS items_n, count(CASE WHEN strlen(v) > 1024 THEN 1 END) AS blobs_n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes_in_use, CAST(0 AS BIGINT) AS sequence FROM b_orders "
       f"UNION ALL SELECT 'customer', count(*), count(CASE WHEN strlen(v) > 1024 THEN 1 END), CAST(sum(strlen(k) + strlen(v)) AS BIGINT), 7 FROM {_CUSTOMER} "
       "UNION ALL SELECT 'doc-' || bucket, count(*), count(CASE WHEN strlen(v) > 1024 THEN 1 END), CAST(sum(strlen(k) + strlen(v)) AS BIGINT), 0 FROM b_docs WHERE v IS NOT NULL AND bucket IS NOT NULL GROUP BY bucket) t")  # fmt: skip
def store_catalog(spark, d):
    """Buckets with the counters that the commits kept."""
    with filled(spark, d).view() as tx:
        return tx.catalog().select(F.decode("name", "UTF-8").alias("name"), "items_n", "blobs_n", "bytes_in_use", "sequence")


@query("SELECT 'doc-' || bucket AS name FROM (SELECT DISTINCT bucket FROM b_docs WHERE bucket IS NOT NULL AND bucket <> 'en' AND v IS NOT NULL) t "
       "UNION ALL SELECT 'customer' UNION ALL SELECT 'orders'")  # fmt: skip
def store_delete_bucket(spark, d):
    """Buckets left after one is deleted, in the transaction that does it."""
    tx = filled(spark, d).begin(write=True)
    try:
        if b"doc-en" in tx.buckets():
            tx.delete_bucket(b"doc-en")
        left = tx.buckets()
    finally:
        tx.rollback()
    return spark.createDataFrame([(n.decode(),) for n in left], "name string")


@query("SELECT k, v FROM (SELECT k, v, op, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM m_events) t WHERE rn = 1 AND op = 'put'")
def store_log(spark, d):
    """A log of puts and removes in four transactions, each folded, committed and read back."""
    from ..operators import fold

    store = filled(spark, d)
    name, log = b"log-" + uuid.uuid4().hex.encode(), event_log(spark, d)
    low, high = log.agg(F.min("seq"), F.max("seq")).head()
    cuts = [(low or 0) + ((high or 0) + 1 - (low or 0)) * k // 4 for k in range(5)]
    for a, z in zip(cuts, cuts[1:]):
        last = fold.latest(log.where((F.col("seq") >= a) & (F.col("seq") < z)))
        with store.update() as tx:
            tx.create_bucket_if_missing(name).apply_df(last)
    with store.view() as tx:
        rows = tx.bucket(name).df
    with store.update() as tx:
        tx.delete_bucket(name)
    return shown(rows)


@query("SELECT r.k, CASE WHEN b.k IS NULL THEN 404 ELSE 200 END AS code, b.v FROM (SELECT '0000000001' AS k UNION ALL SELECT 'missing') r LEFT JOIN b_orders b ON r.k = b.k")
def store_http(spark, d):
    """The same bucket asked over HTTP."""
    import json
    import threading

    from ..cli import Client
    from ..server import make_server

    server = make_server(filled(spark, d), port=0, bucket=b"orders")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client, out = Client("127.0.0.1", server.server_address[1]), []
        for key in ("0000000001", "missing"):
            code, body = client.run("get", key)
            out.append((key, code, json.loads(body).get("value") if code == 200 else None))
    finally:
        server.stop()
    return spark.createDataFrame(out, "k string, code int, v string")
