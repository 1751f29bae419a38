import math

from kvspark.llm import mixing

from .sqlcheck import equal

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert equal(mixing.query(docs), mixing.SQL.replace("{docs}", "documents"), SF)


def check(rows, weights=(5, 2, 1), most=3):
    size, taken, target = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= most * r.size and r.source_size >= r.size
    assert all(r.source_size == size[r.source] for r in rows)
    assert math.isclose(sum(target.values()), sum(size.values()), abs_tol=1e-6)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 and target[s] <= most * size[s] + 1e-9 for s in size)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    levels = [target[s] / weights[i % len(weights)] for i, s in enumerate(names) if target[s] < most * size[s] - 1e-6]
    assert not levels or max(levels) - min(levels) < 1e-6 * max(levels)  # the rest is shared by weight


def test_cases(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 50 else None, i) for i in range(300)]
    rows += [(5, "same words here", "a", 1)] * 4 + [(None, "no id", "b", 1), (900, None, "empty", 1), (901, "x\u00a0y z\x0bq", "d", 1), (902, "l " * 60000, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(got)
    assert {r.size for r in got if r.doc_id in (900, 901)} == {0, 3}
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, mixing.mix(docs.repartition(5)).collect())) == sorted(map(key, got))  # reruns agree
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    monkeypatch.setattr(mixing, "LEAST_DIGITS", 0)
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, got))  # so do other ranges
    assert sorted(map(key, mixing.mix(docs, range_digits=0).collect())) == sorted(map(key, got))
    counts = mixing.mix(docs, range_digits=0)
    pieces = counts._jdf.queryExecution().toString()
    assert "piece" in pieces  # equal rows are dealt to several tasks
    monkeypatch.undo()
    assert mixing.query(docs.limit(0)).collect() == []
    assert [(r.target, r.taken) for r in mixing.mix(docs.where("doc_id = 900")).collect()] == [(0.0, 0)]


def test_one_epoch_and_share(spark):
    docs = spark.createDataFrame([(i, "a b c d", "pq"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(3, 1), share=0.5, max_epochs=1).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "pq"}
    assert taken == {"p": 60, "q": 20}
