import base64
import gzip
import hashlib
import io
import zlib

from kvspark.llm import warc
from kvspark.llm.common import Scratch

from .sqlcheck import equal

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    assert equal(warc.query(spark.read.parquet(f"{SF}/pages.parquet")), warc.SQL, SF)


def test_normaliser_makes_members_and_index():
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n" * 50, bytes(range(256)) * 9000, "é".encode() * 10]
    records = [b"".join(warc.record(i, f"http://h/{i}\n", p, None, False, "2024-01-01T00:00:00Z")) + b"\r\n\r\n" for i, p in enumerate(payloads)]
    whole = gzip.compress(b"".join(records))
    split = gzip.compress(records[0] + records[1]) + gzip.compress(b"".join(records[2:]))
    for source in (whole, split):
        target, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise_file(io.BytesIO(source), target, index, 6) == len(records)
        lines = [x.split("\t") for x in index.getvalue().decode().splitlines()]
        members = [target.getvalue()[int(o) : int(o) + int(n)] for o, n, *_ in lines]
        assert [zlib.decompress(m, 31) for m in members] == records
        assert b"".join(members) == target.getvalue()
        assert [x[4] for x in lines] == [f"http://h/{i}%0A" for i in range(len(records))]


def test_torn_archive_is_noticed():
    record = b"".join(warc.record(1, None, b"abc" * 100, None, False, "2024-01-01T00:00:00Z"))
    for end in (20, len(record) - 5):
        try:
            warc.normalise_file(io.BytesIO(gzip.compress(record[:end])), io.BytesIO(), io.BytesIO(), 6)
        except ValueError:
            continue
        raise AssertionError(end)


def test_cases(spark):
    big = "long é " * 400_000
    rows = [(3, "http://a/\r\nX: y", "dup", 0), (1, "http://b/", "dup", 0), (1, "http://b/", "dup", 0), (2, None, None, 0), (5, "u", "", 0), (None, "n", "only null", 0), (None, "n", "dup", 0), (9, "big", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = sorted(map(tuple, warc.query(pages).collect()), key=repr)
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [
        (3, 3, b32("dup"), "revisit", 1), (1, 3, b32("dup"), "response", None), (1, 3, b32("dup"), "response", None), (2, 0, b32(""), "response", None),
        (5, 0, b32(""), "revisit", 2), (None, 9, b32("only null"), "response", None), (None, 3, b32("dup"), "revisit", 1), (9, len(big.encode()), b32(big), "response", None),
    ]
    assert got == sorted(want, key=repr)
    assert warc.query(pages.limit(0)).collect() == []
    done, folder = warc.archive(pages, least_bytes=4)
    read = warc.read(done, folder).collect()
    assert all(r.record_type == "response" for r in read if r.payload_bytes < 4)
    assert {r.url for r in read if r.page_id == 3} == {"http://a/%0D%0AX:%20y"}


def test_html_stays_where_it_is_read(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    marked = warc.mark_revisits(pages, Scratch(spark, "t"))
    plan = marked._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    by_digest = warc.mark_revisits(pages, Scratch(spark, "t"), broadcast_mb=0)
    key = lambda r: (r.page_id, r.original, r.revisit)
    assert sorted(map(key, marked.collect()), key=repr) == sorted(map(key, by_digest.collect()), key=repr)


def test_rotation(spark):
    pages = spark.range(40).selectExpr("id page_id", "concat('http://h/', id) url", "repeat(cast(id as string), 60000) html")
    done, folder = warc.archive(pages.coalesce(1), rotate_mb=1)
    assert done.count() > 1 and warc.read(done, folder).count() == 40
    assert Scratch(spark, "x").root
