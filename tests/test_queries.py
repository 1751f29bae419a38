"""Every query of the store against its SQL, at two sizes, and the plans that matter at scale."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kvspark.operators import fold, order, scan
from kvspark.plans import queries, stored

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    return con


ALL = {**queries.QUERIES, **stored.QUERIES}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    sf = "sf0.001"
    df = ALL[name](spark, f"/root/testdata/{sf}")
    want = connection(sf).sql({**queries.SQL, **stored.SQL}[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = df.select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.project(", ".join(names)).fetchall()))


def test_stored_keys_reach_the_scan(spark):
    for name in ("store_get", "store_prefix", "store_range"):
        plan = explain(stored.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "GreaterThanOrEqual(key" in plan.split("PushedFilters")[1] and "LessThan(key" in plan and "Exchange" not in plan


def test_documents_are_not_read_for_each_bucket(spark, tmp_path):
    """Jobs that fill a store do not grow with the languages of the documents."""
    def jobs(n):
        d = tmp_path / str(n)
        d.mkdir()
        for t in ("orders", "customer"):
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", d / f"{t}.parquet")
        docs = spark.range(200).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.format_string("l%02d", F.col("id") % n).alias("lang"))
        docs.coalesce(1).write.parquet(str(d / "documents.parquet"))
        group = f"fill-{n}-{tmp_path}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            store = stored.filled(spark, str(d))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sum(b["ItemsN"] for name, b in store.status()["Buckets"].items() if name.startswith("doc-l")) == 200
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20) <= jobs(2) + 2


def explain(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "b")
    b = spark.range(1000).select(F.encode(F.lpad(F.col("id").cast("string"), 6, "0"), "UTF-8").alias("key"), F.lit(b"v").alias("value"))
    b.write.parquet(path)
    b = spark.read.parquet(path)
    plan = explain(scan.prefix(b, b"0001"))
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "Exchange" not in plan
    assert "TakeOrderedAndProject" in explain(scan.seek(b, b"0005"))
    assert "WindowGroupLimit" in explain(fold.fold(b.select("key", "value", F.lit("put").alias("op"), F.lit(1).cast("long").alias("seq"))))
    assert "value" not in explain(scan.key_range(b, b"0", b"1").select("key")).split("ReadSchema")[1]


def test_positions_without_a_single_partition(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    out = order.positions(df, "x")
    got = sorted((r.x, r.pos) for r in out.collect())
    assert [p for _, p in got] == list(range(1, 5001))
    assert order.positions(df.limit(0), "x").collect() == []
    near = {r.x: (r.n, r.p) for r in order.neighbours(df, "x", "n", "p").collect()}
    xs = sorted(near)
    assert all(near[x] == (xs[i + 1] if i + 1 < len(xs) else None, xs[i - 1] if i else None) for i, x in enumerate(xs))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.basename(__spark_entry__.__file__) == "__spark_entry__.py"
