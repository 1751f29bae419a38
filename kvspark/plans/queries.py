"""The store's operators over the driver's tables, each with its SQL.

Tables play buckets; keys and values are binary inside and printed as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fold, order, scan, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTES = {
    "b_orders": "SELECT lpad(CAST(o_orderkey AS STRING),10,'0') AS k, concat(o_orderstatus,'|',o_orderpriority) AS v FROM orders",
    "b_cust": "SELECT c_name AS k, c_mktsegment AS v FROM customer",
    "b_docs": "SELECT lang AS bucket, concat('doc/',lpad(CAST(doc_id AS STRING),8,'0')) AS k, text AS v FROM documents",
    "m_part": "SELECT p_partkey AS seq, p_name AS k, p_brand AS v FROM part",
    "m_events": "SELECT event_id AS seq, event_id - event_id % 100 AS txn, event_type AS bucket, lpad(CAST(user_id AS STRING),8,'0') AS k, "
    "CASE WHEN event_type='error' THEN 'del' ELSE 'put' END AS op, props AS v FROM events",
}


def query(sql: str):
    """Registers a query with its SQL, which may read the tables above."""

    def add(f):
        used = [f"{n} AS ({s})" for n, s in _CTES.items() if n in sql]
        SQL[f.__name__] = f"WITH {', '.join(used)} {sql}" if used else sql
        QUERIES[f.__name__] = f
        return f

    return add


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _binary(c):
    return F.encode(c, "UTF-8")


def orders_bucket(spark, d):
    o = _read(spark, d, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return o.select(_binary(key).alias("key"), _binary(F.concat("o_orderstatus", F.lit("|"), "o_orderpriority")).alias("value"))


def customer_bucket(spark, d):
    return _read(spark, d, "customer").select(_binary(F.col("c_name")).alias("key"), _binary(F.col("c_mktsegment")).alias("value"))


def document_buckets(spark, d):
    key = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return _read(spark, d, "documents").select(F.col("lang").alias("bucket"), _binary(key).alias("key"), _binary(F.col("text")).alias("value"))


def part_log(spark, d):
    p = _read(spark, d, "part")
    return p.select(_binary(F.col("p_name")).alias("key"), _binary(F.col("p_brand")).alias("value"), F.lit("put").alias("op"), F.col("p_partkey").alias("seq"))


def event_log(spark, d):
    return _read(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") - F.col("event_id") % 100).alias("txn"),
        F.col("event_type").alias("bucket"),
        _binary(F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"),
        _binary(F.col("props")).alias("value"),
    )


def shown(df: DataFrame) -> DataFrame:
    names = {"key": "k", "value": "v", "next_key": "next_k", "prev_key": "prev_k"}
    return df.select([text(F.col(c)).alias(names[c]) if c in names else F.col(c) for c in df.columns])


def _requests(spark, *keys: str):
    return spark.createDataFrame([(bytearray(k.encode()),) for k in keys], "key binary")


@query("SELECT k, v FROM b_orders WHERE k = '0000000042'")
def get_point(spark, d):
    return shown(scan.get(orders_bucket(spark, d), b"0000000042"))


@query(
    "SELECT r.k, b.v, b.k IS NOT NULL AS found FROM (SELECT '0000000001' AS k UNION ALL SELECT '0000000777' UNION ALL SELECT 'missing') r LEFT JOIN b_orders b ON r.k = b.k"
)
def multi_get(spark, d):
    return shown(scan.multi_get(orders_bucket(spark, d), _requests(spark, "0000000001", "0000000777", "missing")))


@query("SELECT k, v FROM b_orders ORDER BY k LIMIT 1")
def scan_first(spark, d):
    return shown(scan.first(orders_bucket(spark, d)))


@query("SELECT k, v FROM b_orders ORDER BY k DESC LIMIT 1")
def scan_last(spark, d):
    return shown(scan.last(orders_bucket(spark, d)))


@query("SELECT k, v FROM b_orders WHERE k >= '0000000500' ORDER BY k LIMIT 1")
def seek_exact(spark, d):
    return shown(scan.seek(orders_bucket(spark, d), b"0000000500"))


@query("SELECT k, v FROM b_orders WHERE k >= '00000005005' ORDER BY k LIMIT 1")
def seek_between(spark, d):
    return shown(scan.seek(orders_bucket(spark, d), b"00000005005"))


@query("SELECT k, v FROM b_orders WHERE k > '0000000500' ORDER BY k LIMIT 1")
def cursor_next(spark, d):
    return shown(scan.page_after(orders_bucket(spark, d), b"0000000500", 1))


@query("SELECT k, v FROM b_orders WHERE k < '0000000500' ORDER BY k DESC LIMIT 1")
def cursor_prev(spark, d):
    return shown(scan.page_before(orders_bucket(spark, d), b"0000000500", 1))


@query("SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM b_cust")
def scan_forward(spark, d):
    return shown(scan.forward(customer_bucket(spark, d)))


@query("SELECT row_number() OVER (ORDER BY k DESC) AS pos, k, v FROM b_cust")
def scan_reverse(spark, d):
    return shown(scan.reverse(customer_bucket(spark, d)))


@query("SELECT row_number() OVER (ORDER BY k DESC) AS pos, k, v FROM b_cust WHERE k <= 'Customer#000000299'")
def seek_then_prev(spark, d):
    return shown(scan.reverse(customer_bucket(spark, d), b"Customer#000000299"))


@query("SELECT k, lead(k) OVER (ORDER BY k) AS next_k, lag(k) OVER (ORDER BY k) AS prev_k FROM b_cust")
def neighbours(spark, d):
    return shown(scan.neighbours(customer_bucket(spark, d)))


@query("SELECT k, v FROM b_orders WHERE k >= '00000001' AND k < '00000002'")
def prefix_scan(spark, d):
    return shown(scan.prefix(orders_bucket(spark, d), b"00000001"))


@query("SELECT k, v FROM b_orders WHERE k >= '0000000100' AND k < '0000000200'")
def range_scan(spark, d):
    return shown(scan.key_range(orders_bucket(spark, d), b"0000000100", b"0000000200"))


@query("SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM (SELECT k, v FROM b_orders WHERE k >= '0000000250' ORDER BY k LIMIT 50) t")
def seek_take_n(spark, d):
    return shown(scan.take(orders_bucket(spark, d), b"0000000250", 50))


@query(
    "SELECT pos, k, v FROM (SELECT pos, k, v, min(CASE WHEN k LIKE '%777' THEN pos END) OVER () AS stop FROM "
    "(SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM b_cust) a) b WHERE stop IS NULL OR pos < stop"
)
def for_each_stop(spark, d):
    return shown(scan.take_while(customer_bucket(spark, d), text(F.col("key")).endswith("777")))


@query("SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM m_part) t WHERE rn = 1")
def put_overwrite(spark, d):
    return shown(fold.fold(part_log(spark, d)))


@query("SELECT b.k, b.v FROM b_cust b WHERE NOT EXISTS (SELECT 1 FROM b_cust d WHERE d.v = 'BUILDING' AND d.k = b.k)")
def remove_keys(spark, d):
    b = customer_bucket(spark, d)
    return shown(fold.remove(b, b.where(F.col("value") == F.lit(bytearray(b"BUILDING")))))


_FOLD = "SELECT k, v FROM (SELECT k, v, op, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM m_events{}) t WHERE rn = 1 AND op = 'put'"


@query(_FOLD.format(""))
def log_fold(spark, d):
    return shown(fold.fold(event_log(spark, d)))


@query(_FOLD.format(" WHERE txn % 300 <> 0"))
def log_fold_rollback(spark, d):
    return shown(fold.fold(event_log(spark, d), committed=F.col("txn") % 300 != 0))


@query(_FOLD.format(" WHERE seq < 500"))
def snapshot_read(spark, d):
    return shown(fold.fold(event_log(spark, d), before=500))


@query("SELECT row_number() OVER (ORDER BY bucket) AS pos, bucket FROM (SELECT DISTINCT bucket FROM b_docs) t")
def list_buckets(spark, d):
    return order.positions(document_buckets(spark, d).select("bucket").distinct(), "bucket")


@query("SELECT row_number() OVER (ORDER BY bucket) AS pos, bucket FROM (SELECT DISTINCT bucket FROM b_docs WHERE bucket <> 'en') t")
def delete_bucket(spark, d):
    left = document_buckets(spark, d).where("bucket <> 'en'")
    return order.positions(left.select("bucket").distinct(), "bucket")


@query(
    "SELECT bucket, count(*) AS items_n, count(CASE WHEN strlen(v) > 1024 THEN 1 END) AS blobs_n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes_in_use FROM b_docs GROUP BY bucket"
)
def bucket_stat(spark, d):
    return stats.bucket_stat(document_buckets(spark, d), "bucket")


@query("SELECT count(DISTINCT bucket) AS buckets_n, count(*) AS items_n, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes_in_use FROM b_docs")
def db_stat(spark, d):
    return stats.db_stat(document_buckets(spark, d))


@query("SELECT k, CAST(CASE WHEN strlen(v) <= 4079 THEN 1 ELSE 1 + ceil((strlen(v) - 4079) / 4087.0) END AS BIGINT) AS pages FROM b_docs WHERE strlen(v) > 1024")
def blob_pages(spark, d):
    return shown(stats.blobs(document_buckets(spark, d)))


@query(
    "SELECT k, CASE WHEN strlen(v) >= 512 THEN 'key too large' ELSE 'ok' END AS as_key, CASE WHEN strlen(v) > 1024 THEN 'blob' ELSE 'inline' END AS as_value FROM b_docs"
)
def classify_put(spark, d):
    return shown(stats.classify(document_buckets(spark, d)))


@query("SELECT bucket, seq, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS id FROM m_events")
def next_sequence(spark, d):
    return fold.sequences(event_log(spark, d))


@query("SELECT bucket, count(*) AS sequence FROM m_events GROUP BY bucket")
def sequence(spark, d):
    return fold.sequence(event_log(spark, d))


@query("SELECT r.k, CASE WHEN b.k IS NULL THEN 404 ELSE 200 END AS code, b.v FROM (SELECT '0000000001' AS k UNION ALL SELECT 'missing') r LEFT JOIN b_orders b ON r.k = b.k")
def http_get(spark, d):
    found = scan.multi_get(orders_bucket(spark, d), _requests(spark, "0000000001", "missing"))
    return shown(found.select("key", F.when(F.col("found"), 200).otherwise(404).alias("code"), "value"))
