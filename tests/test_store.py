import json
import os
import random
import threading
import time

import pytest

from kvspark import functions as fn
from kvspark.functions import BadStore, BucketExists, BucketNotFound, KeyNotFound, KeyTooLarge, StoreLocked, TxClosed, WriteInReadTransaction
from kvspark.sources import Options, Store


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        yield s


def rows(spark, n, f="test_{:05d}", g="value_{}"):
    from pyspark.sql import functions as F

    key = F.encode(F.format_string(f.replace("{:05d}", "%05d").replace("{}", "%d"), "id"), "UTF-8")
    value = F.encode(F.format_string(g.replace("{}", "%d"), "id"), "UTF-8")
    return spark.range(n).select(key.alias("key"), value.alias("value"))


def held(store, name=b"b"):
    with store.view() as tx:
        return dict(tx.bucket(name).items())


def test_put_get_remove_reopen(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store.open(spark, path) as store:
        with store.update() as tx:
            b = tx.create_bucket(b"b")
            b.put(b"foo", b"bar")
            b.put(b"", b"")
            assert b.get(b"foo") == (b"bar", True) and b.get(b"") == (b"", True) and b.get(b"x") == (None, False)
        with store.update() as tx:
            tx.bucket(b"b").remove(b"foo")
            with pytest.raises(KeyNotFound):
                tx.bucket(b"b").remove(b"foo")
        assert held(store) == {b"": b""}
    with Store.open(spark, path) as store:
        assert held(store) == {b"": b""}
        with store.update() as tx:
            tx.bucket(b"b").put(b"later", b"1")
        assert held(store) == {b"": b"", b"later": b"1"}


def test_limits_and_order(store):
    with store.update() as tx:
        b = tx.create_bucket(b"b")
        with pytest.raises(KeyTooLarge):
            b.put(b"k" * 512, b"")
        b.put(b"k" * 511, b"")
        b.remove(b"k" * 511)
        for key in (b"\x7f", b"\x80", b"\x7f\x00", b""):
            b.put(key, key)
        assert [k for k, _ in b.items()] == [b"", b"\x7f", b"\x7f\x00", b"\x80"]
        with pytest.raises(KeyTooLarge):
            tx.create_bucket(b"n" * 512)
    assert [fn.successor(p) for p in (b"\xff", b"\xff\xff", b"a\xff", b"", b"ab")] == [None, None, b"b", None, b"ac"]


def test_stats_follow_live_rows(store):
    def stat():
        return store.status()["Buckets"]["b"]

    sizes = [(b"x" * 10, 0), (b"x" * 2000, 1), (b"x" * 1024, 0), (b"x" * 1025, 1)]
    for i, (value, blobs) in enumerate(sizes):
        with store.update() as tx:
            tx.create_bucket_if_missing(b"b").put(b"key", value)
            assert tx.bucket(b"b").stat() == {"items_n": 1, "blobs_n": blobs, "bytes_in_use": 3 + len(value)}
        assert stat() == {"ItemsN": 1, "BlobsN": blobs, "BytesInUse": 3 + len(value)}, i
    with store.update() as tx:
        tx.bucket(b"b").remove(b"key")
    assert stat() == {"ItemsN": 0, "BlobsN": 0, "BytesInUse": 0}


def test_bulk_random_removes_keep_survivors(spark, store):
    with store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, 2000))
    want = {f"test_{i:05d}".encode(): f"value_{i}".encode() for i in range(2000)}
    assert held(store) == want
    gone = random.Random(1).sample(sorted(want), 1997)
    with store.update() as tx:
        tx.bucket(b"b").remove_df(spark.createDataFrame([(bytearray(k),) for k in gone], "key binary"))
    survivors = {k: v for k, v in want.items() if k not in set(gone)}
    assert held(store) == survivors and store.status()["Buckets"]["b"]["ItemsN"] == 3
    with store.update() as tx:
        with pytest.raises(ValueError):
            tx.bucket(b"b").put_df(rows(spark, 2).unionByName(rows(spark, 1)))


def test_deltas_compact(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Options(compact_after=2)) as store:
        for i in range(4):
            with store.update() as tx:
                tx.create_bucket_if_missing(b"b").put(f"k{i}".encode(), b"v")
        entry = store.current.buckets[b"b"]
        assert entry.base and len(entry.deltas) == 1 and entry.items_n == 4
        assert len(held(store)) == 4
        assert store.vacuum() and len(held(store)) == 4 and store.vacuum() == []


def files(store):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(os.path.join(store.path, "data")) for n in names if n.endswith(".parquet")}


def jobs(spark, work):
    """How many jobs some work runs."""
    status = spark.sparkContext.statusTracker()
    group = f"jobs-{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(status.getJobIdsForGroup(group))


def test_writes_follow_the_change(spark, store):
    with store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, 200_000))
    large = files(store)
    want = {f"test_{i:05d}".encode(): f"value_{i}".encode() for i in range(200_000)}
    for k in range(12):
        with store.update() as tx:
            b = tx.bucket(b"b")
            b.put_df(rows(spark, 10, f=f"new_{k}_" + "{:05d}"))
            b.remove_df(spark.createDataFrame([(bytearray(b"test_%05d" % k),), (bytearray(b"none"),)], "key binary"))
        want |= {f"new_{k}_{i:05d}".encode(): f"value_{i}".encode() for i in range(10)}
        del want[b"test_%05d" % k]
        written = {f: n for f, n in files(store).items() if f not in large}
        assert sum(written.values()) < sum(large.values()) / 4 and all(f in files(store) for f in large)
    entry = store.current.buckets[b"b"]
    assert len(entry.deltas) <= store.options.compact_after + 1 and entry.items_n == len(want) == 200_000 + 108
    assert held(store) == want
    with store.view() as tx:
        plan = tx.bucket(b"b").df._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert tx.bucket(b"b").get(b"test_00003") == (None, False) and tx.bucket(b"b").get(b"new_3_00002") == (b"value_2", True)


def test_many_removes_take_few_jobs(spark, store):
    with store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, 20_000))
    keys = [b"test_%05d" % i for i in range(0, 20_000, 2)]

    def remove():
        with store.update() as tx:
            tx.bucket(b"b").remove_many(keys)

    assert jobs(spark, remove) < 20
    assert store.status()["Buckets"]["b"]["ItemsN"] == 10_000
    with store.update() as tx, pytest.raises(KeyNotFound):
        tx.bucket(b"b").remove_many([b"test_00001", b"test_00002"])
    with store.view() as tx:
        assert tx.bucket(b"b").get(b"test_00001")[1]


def test_a_folded_log_is_not_committed_in_one_task(spark, store):
    """The parts of a fold are sorted in tasks of their own, not all in the one that writes."""
    from pyspark.sql import functions as F

    from kvspark.operators import fold

    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    log = rows(spark, 20_000).select("key", "value", F.when(F.xxhash64("key") % 5 == 0, "del").otherwise("put").alias("op"), F.lit(1).cast("long").alias("seq"))
    sinks = spark.sparkContext._jsc.sc().statusStore()
    status, group = spark.sparkContext.statusTracker(), f"memory-{time.time()}"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        for _ in range(2):
            with store.update() as tx:
                last = fold.latest(log)
                b = tx.create_bucket_if_missing(b"b")
                b.put_df(last.where("op = 'put'"))
                b.remove_df(last.where("op = 'del'"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    peaks = []
    for job in status.getJobIdsForGroup(group):
        for stage in status.getJobInfo(job).stageIds:
            tasks = sinks.taskList(stage, 0, 1000)
            peaks += [tasks.apply(i).taskMetrics().get().peakExecutionMemory() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]
    assert len(peaks) > 48 and max(peaks) < 600 << 20  # MB: a few sorts of a page each
    want = log.where("op = 'put'").count()
    assert store.status()["Buckets"]["b"]["ItemsN"] == want
    with store.view() as tx:
        assert tx.bucket(b"b").df.count() == want


def test_apply_df(spark, store):
    """Puts and removes in one log; what is wrong with a log is said before anything is written."""
    log = lambda *r: spark.createDataFrame([(k and bytearray(k), v and bytearray(v), op) for k, v, op in r], "key binary, value binary, op string")
    with store.update() as tx:
        b = tx.create_bucket(b"b")
        b.apply_df(log((b"a", b"1", "put"), (b"b", None, "del"), (b"c", b"3", "put")))
        assert dict(b.items()) == {b"a": b"1", b"c": b"3"}
    with store.update() as tx:
        b = tx.bucket(b"b")
        b.apply_df(log((b"a", b"0", "del"), (b"none", None, "del"), (b"d", b"4", "put")))
        b.put(b"e", b"5")
    assert held(store) == {b"c": b"3", b"d": b"4", b"e": b"5"}
    assert store.status()["Buckets"]["b"] == {"ItemsN": 3, "BlobsN": 0, "BytesInUse": 6}
    bad = [(b"x", None, "put")], [(b"x", b"1", "move")], [(b"x", b"1", None)], [(None, b"1", "put")], [(b"x", b"1", "put"), (b"x", b"1", "del")]
    with store.update() as tx:
        for r in bad:
            with pytest.raises(ValueError):
                tx.bucket(b"b").apply_df(log(*r))
        with pytest.raises(KeyTooLarge):
            tx.bucket(b"b").apply_df(log((b"k" * 512, b"1", "put")))
    assert held(store) == {b"c": b"3", b"d": b"4", b"e": b"5"}


def test_load_df(spark, store):
    """Buckets made and filled together are as if filled one by one."""
    table = lambda *r: spark.createDataFrame([tuple(x if x is None else bytearray(x) for x in row) for row in r], "bucket binary, key binary, value binary")
    many = [(b"n" * 511 if i % 7 else b"", b"%03d" % i, b"x" * i) for i in range(2000)]
    with store.update() as tx:
        tx.create_bucket(b"old").put(b"k", b"v")
        tx.load_df(table(*many))
        tx.load_df(table((b"gone", b"a", b"1"), (b"kept", b"a", b"2")))
        tx.delete_bucket(b"gone")
        tx.bucket(b"kept").put(b"b", b"3")
        assert tx.buckets() == [b"", b"kept", b"n" * 511, b"old"]
    store.vacuum()
    for name in (b"", b"n" * 511):
        want = {k: v for n, k, v in many if n == name}
        assert held(store, name) == want
        stat = store.status()["Buckets"][name.decode()]
        assert stat == {"ItemsN": len(want), "BlobsN": sum(len(v) > 1024 for v in want.values()), "BytesInUse": sum(len(k) + len(v) for k, v in want.items())}
    assert held(store, b"kept") == {b"a": b"2", b"b": b"3"}
    before = files(store)
    dropped = store.begin(write=True)
    dropped.load_df(table((b"lost", b"a", b"1")))
    dropped.rollback()
    with store.update() as tx:
        for row, error in (((b"old", b"a", b"1"), BucketExists), ((None, b"a", b"1"), ValueError), ((b"new", None, b"1"), ValueError), ((b"new", b"a", None), ValueError), ((b"n" * 512, b"a", b"1"), KeyTooLarge)):
            with pytest.raises(error):
                tx.load_df(table((b"fine", b"a", b"1"), row))
        with pytest.raises(ValueError):
            tx.load_df(table((b"fine", b"a", b"1"), (b"fine", b"a", b"2")))
        tx.load_df(table())
        assert tx.buckets() == [b"", b"kept", b"n" * 511, b"old"]
    assert files(store) == before


def test_options(spark, tmp_path):
    log = tmp_path / "log"
    with Store.open(spark, str(tmp_path / "s"), Options(mode=0o700, log_path=str(log))) as store:
        for _ in range(2):
            with store.update() as tx:
                tx.create_bucket_if_missing(b"b").put(b"k", b"v")
        assert os.stat(os.path.join(store.path, "lock")).st_mode & 0o777 == 0o600
    assert log.read_text().splitlines() == ["1\t1 buckets", "2\t1 buckets"]


@pytest.mark.parametrize("n", [1_000_000])
def test_reference_sizes(spark, store, n):
    """A million keys put, half of them removed chunk by chunk; and a million random ones."""
    from pyspark.sql import functions as F

    with store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, n, f="test_{}"))
    chunk = 100_000
    with store.update() as tx:
        b = tx.bucket(b"b")
        for k in range(n // 2 // chunk):
            ids = spark.range(k * chunk, (k + 1) * chunk).select(F.encode(F.format_string("test_%d", F.col("id") * 2), "UTF-8").alias("key"))
            b.remove_df(ids)
    assert store.status()["Buckets"]["b"]["ItemsN"] == n // 2
    with store.view() as tx:
        left = tx.bucket(b"b").df.where(F.expr("substr(decode(key, 'UTF-8'), 6) % 2 = 0")).count()
        assert left == 0 and tx.bucket(b"b").get(b"test_999999") == (b"value_999999", True)
    letters = F.translate(F.substring(F.hex(F.xxhash64("id")), 1, 8), "0123456789ABCDEF", "abcdefghABCDEFGH")
    random_rows = spark.range(n).select(F.encode(letters, "UTF-8").alias("key"), F.lit(b"a" * 32).alias("value")).dropDuplicates(["key"])
    with store.update() as tx:
        tx.create_bucket(b"r").put_df(random_rows)
    assert store.status()["Buckets"]["r"]["ItemsN"] == random_rows.count()


def test_many_buckets_and_a_long_walk(spark, store):
    with store.update() as tx:
        for i in range(1000):
            tx.create_bucket(b"bucket_%03d" % i)
        tx.bucket(b"bucket_000").put_df(rows(spark, 10_000, f="{:05d}"))
    with store.view() as tx:
        assert tx.buckets() == sorted(b"bucket_%03d" % i for i in range(1000))
        b, seen = tx.bucket(b"bucket_000"), []
        b.for_each(lambda k, v: seen.append(k))
        assert seen == [b"%05d" % i for i in range(10_000)]
        assert b.prefix(b"03").count() == 1000


def test_buckets(store):
    with store.update() as tx:
        for i in (2, 0, 1):
            tx.create_bucket(b"bucket_%03d" % i)
        with pytest.raises(BucketExists):
            tx.create_bucket(b"bucket_001")
        assert tx.create_bucket_if_missing(b"bucket_001") is tx.bucket(b"bucket_001")
    with store.view() as tx:
        assert tx.buckets() == [b"bucket_%03d" % i for i in range(3)]
        assert [bytes(r.name) for r in tx.catalog().orderBy("name").collect()] == tx.buckets()
        with pytest.raises(BucketNotFound):
            tx.bucket(b"none")
        with pytest.raises(WriteInReadTransaction):
            tx.create_bucket(b"x")
    with store.update() as tx:
        b = tx.bucket(b"bucket_001")
        b.put(b"k", b"v")
        tx.delete_bucket(b"bucket_001")
        with pytest.raises(KeyNotFound):
            tx.delete_bucket(b"bucket_001")
        with pytest.raises(BucketNotFound):
            b.put(b"k", b"v")
    with store.view() as tx:
        assert tx.buckets() == [b"bucket_000", b"bucket_002"]


def test_for_each_stops(spark, store):
    with store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, 100))
    seen = []

    def f(key, value):
        if key.endswith(b"7"):
            raise LookupError(key)
        seen.append(key)

    with store.view() as tx, pytest.raises(LookupError):
        tx.bucket(b"b").for_each(f)
    assert seen == [b"test_%05d" % i for i in range(7)]


def test_sequence(store):
    with store.update() as tx:
        b = tx.create_bucket(b"b")
        assert [b.next_sequence() for _ in range(3)] == [1, 2, 3] and b.sequence() == 3
        assert b.next_sequence(10) == 4
    with store.view() as tx:
        assert tx.bucket(b"b").sequence() == 13
        with pytest.raises(WriteInReadTransaction):
            tx.bucket(b"b").next_sequence()


def test_rollback_and_closed(spark, store):
    with pytest.raises(ZeroDivisionError), store.update() as tx:
        tx.create_bucket(b"b").put_df(rows(spark, 5))
        1 / 0
    with store.view() as tx:
        assert tx.buckets() == []
    with store.update() as tx:
        b = tx.create_bucket(b"b")
        b.put(b"a", b"1")
    for call in (lambda: b.put(b"a", b"2"), lambda: b.get(b"a"), tx.commit, tx.buckets):
        with pytest.raises(TxClosed):
            call()
    with store.view() as tx:
        for call in (lambda: tx.bucket(b"b").put(b"a", b"2"), lambda: tx.bucket(b"b").remove(b"a")):
            with pytest.raises(WriteInReadTransaction):
                call()


def test_isolation(store):
    with store.update() as tx:
        tx.create_bucket(b"b").put(b"key", b"initial")
    reader = store.begin()
    assert store.status()["TxN"] == 1
    with store.update() as tx:
        tx.bucket(b"b").put(b"key", b"modified")
        assert reader.bucket(b"b").get(b"key")[0] == b"initial"
    store.vacuum()
    assert reader.bucket(b"b").get(b"key")[0] == b"initial"
    reader.rollback()
    assert held(store)[b"key"] == b"modified"
    order = []
    first = store.begin(write=True)

    def second():
        with store.update() as tx:
            order.append("second")
            tx.bucket(b"b").put(b"key", b"second")

    thread = threading.Thread(target=second)
    thread.start()
    time.sleep(0.3)
    order.append("first")
    first.bucket(b"b").put(b"key", b"first")
    first.commit()
    thread.join()
    assert order == ["first", "second"] and held(store)[b"key"] == b"second"


def test_crash_before_and_after_the_link(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store.open(spark, path)
    with store.update() as tx:
        tx.create_bucket(b"users").put(b"id", b"1")
    tx = store.begin(write=True)
    tx.bucket(b"users").put(b"id", b"2")

    def crash():
        raise KeyboardInterrupt

    tx._before_publish = crash
    with pytest.raises(KeyboardInterrupt):
        tx.commit()
    with pytest.raises(StoreLocked):
        Store.open(spark, path)
    store.close()
    store.close()
    with Store.open(spark, path) as store:
        assert held(store, b"users") == {b"id": b"1"}
        version = store.current.version
    # A torn version: the one before is opened with recovery, none without.
    with open(os.path.join(path, "_manifest", f"{version + 1:020d}.json"), "w") as f:
        json.dump({"version": version + 1}, f)
    with pytest.raises(BadStore):
        Store.open(spark, path, Options(recovery=False))
    with Store.open(spark, path) as store:
        assert held(store, b"users") == {b"id": b"1"} and store.current.version == version
        with store.update() as tx:
            tx.bucket(b"users").put(b"id", b"3")
    with Store.open(spark, path) as store:
        assert held(store, b"users") == {b"id": b"3"}
    other = tmp_path / "other"
    other.mkdir()
    (other / "file").write_text("")
    with pytest.raises(BadStore):
        Store.open(spark, str(other))


def test_cursor(spark, store):
    with store.update() as tx:
        b = tx.create_bucket(b"b")
        assert b.cursor().first() == b.cursor().last() == b.cursor().seek(b"x") == (None, None)
        b.put_df(rows(spark, 500, f="{:05d}", g="{}"))
        b.put(b"00010", b"x" * 3000)
        c = b.cursor()
        c._page_rows = 64
        key = lambda i: b"%05d" % i
        assert c.next() == c.prev() == (None, None)
        assert c.first() == (key(0), b"0") and c.prev() == (None, None) and c.next()[0] == key(0)
        seen = [c.first()]
        while (item := c.next()) != (None, None):
            seen.append(item)
        assert [k for k, _ in seen] == [key(i) for i in range(500)] and c.next() == (None, None)
        assert c.prev()[0] == key(499)
        assert c.seek(b"00299") == (key(299), b"299")
        back = [c.prev() for _ in range(300)]
        assert [k for k, _ in back[:299]] == [key(i) for i in range(298, -1, -1)] and back[-1] == (None, None)
        assert back[288][1] == b"x" * 3000
        assert c.seek(b"002995") == (key(300), b"300") and c.next()[0] == key(301) and c.prev()[0] == key(300)
        assert c.seek(b"9") == (None, None) and c.prev()[0] == key(499)
        assert c.last()[0] == key(499) and c.next() == (None, None)
        assert b.prefix(b"003").count() == 100 and b.prefix(b"").count() == 500


def test_u64(spark):
    numbers = [0, 1, 255, 256, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = df.select("n", fn.encode_u64(df.n).alias("k")).select("n", "k", fn.decode_u64(fn.encode_u64(df.n)).alias("back")).collect()
    assert all(bytes(r.k) == fn.u64_bytes(r.n) and int(r.back) == r.n for r in got)


def test_stream(spark, store, tmp_path):
    from pyspark.sql import functions as F

    from kvspark.streaming import apply_stream

    source = str(tmp_path / "in")
    log = spark.range(20).select(
        F.encode(F.format_string("k%d", F.col("id") % 5), "UTF-8").alias("key"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("value"),
        F.when(F.col("id") == 19, "del").otherwise("put").alias("op"),
        F.col("id").alias("seq"),
    )
    log.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    q = apply_stream(stream, store, b"b", "t", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert held(store) == {b"k0": b"15", b"k1": b"16", b"k2": b"17", b"k3": b"18"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_transactions_against_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    key = lambda: bytes(rng.choices(b"\x00a\xff", k=rng.randrange(4)))
    want: dict[bytes, bytes] = {}
    path = str(tmp_path / "s")
    with Store.open(spark, path, Options(compact_after=2)) as store:
        with store.update() as tx:
            tx.create_bucket(b"b")
        for _ in range(6):
            now = dict(want)
            tx = store.begin(write=True)
            b = tx.bucket(b"b")
            for _ in range(8):
                k, kind = key(), rng.random()
                if kind < 0.6:
                    now[k] = bytes(rng.choices(b"xyz", k=rng.choice([0, 1, 1024, 1025])))
                    b.put(k, now[k])
                elif kind < 0.8 and k in now:
                    b.remove(k)
                    del now[k]
                elif kind > 0.95:
                    bulk = {key(): b"bulk" for _ in range(3)}
                    b.put_df(spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in bulk.items()], "key binary, value binary"))
                    now |= bulk
            assert dict(b.items()) == now
            if rng.random() < 0.7:
                tx.commit()
                want = now
            else:
                tx.rollback()
        stat = store.status()["Buckets"]["b"]
        assert stat == {"ItemsN": len(want), "BlobsN": sum(len(v) > 1024 for v in want.values()), "BytesInUse": sum(len(k) + len(v) for k, v in want.items())}
    with Store.open(spark, path) as store, store.view() as tx:
        c, seen = tx.bucket(b"b").cursor(), []
        item = c.first()
        while item != (None, None):
            seen.append(item)
            item = c.next()
        assert seen == sorted(want.items())
        for k in (b"", b"a", b"a\xff", b"\xff\xff\xff\xff"):
            after = [x for x in sorted(want) if x >= k]
            assert c.seek(k)[0] == (after[0] if after else None)
