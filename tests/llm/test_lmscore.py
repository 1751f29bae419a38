import math
import re
import zlib
from collections import Counter

import numpy as np

from kvspark.llm import lmscore

SF = "/root/testdata/sf0.01"


def plain(rows):
    """rows: (doc_id, text) -> per row what the query's exact columns should be."""

    def split(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for h, (_, t) in zip(held, rows) if not h for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for h, (i, t) in zip(held, rows):
        own = split(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, h, len(own), sum(counts[w] > 0 for w in own), n, base))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for frequent in (1 << 20, 500):  # all counts broadcast, or most of them in the shards
        got = [tuple(r) for r in lmscore.query(docs, frequent=frequent).collect()]
        same(got, plain(rows))
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)  # the model beats the base
        assert all(r[6] < 0 for r in got)


def test_filter():
    rng = np.random.default_rng(5)
    levels = lmscore.Levels()
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    counts = rng.integers(1, 3000, len(keys))
    block = lmscore.LogBloom.block(keys, counts, 1 << 16, 4, levels)
    bloom = lmscore.LogBloom(np.frombuffer(block, np.uint8), 1, 1 << 16, 4, levels)
    read = bloom.count(keys)
    assert (levels.of(np.maximum(1, np.rint(read).astype(int))) >= levels.of(counts)).mean() > 0.99
    assert np.median(np.abs(np.log(read / counts))) < 0.3
    assert (bloom.count(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.1
    tight = lmscore.LogBloom.block(keys, counts, 1 << 11, 4, levels)
    assert np.unpackbits(np.frombuffer(tight, np.uint8)).mean() < 0.6


def test_cases(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A b a"), (3, "A b a"), (None, "b c"), (7, "x " * 50000), (8, "É é")]
    docs = spark.createDataFrame([(i, t, 1.5, "k") for i, t in rows], "doc_id long, text string, score double, blob string")
    same([tuple(r) for r in lmscore.query(docs).collect()], plain(rows))
    monkeypatch.setattr(lmscore, "MOST_TASKS", 3)  # several shards a task
    same([tuple(r) for r in lmscore.query(docs).collect()], plain(rows))
    assert lmscore.query(docs.limit(0)).collect() == []
    only = docs.where("doc_id = 3")
    assert {r.n_known for r in lmscore.score(only, only.limit(0)).collect()} == {0}


def test_no_ngram_stays_out(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 100_000, 20_000))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # Two million n-grams seen once: a filter of one MB in all had no room for them.
    got = {r.doc_id: r for r in lmscore.score(docs, docs, filter_mb=1).collect()}
    words = [t.split() for _, t in rows]
    counts, pairs = Counter(w for t in words for w in [*t, None]), Counter()
    for t in words:
        pairs.update(zip([0, *t], [*t, None]))
    total = sum(counts.values())
    for i, t in enumerate(words[:5]):
        want = 0.0
        for a, b in zip([0, *t], [*t, None]):
            before = counts[a] if a else len(rows)
            p = (counts[b] + 0.5) / (total + 0.5 * (len(counts) + 1))
            want += math.log10((min(pairs[a, b], before) + 1000 * p) / (before + 1000))
        assert abs(got[i].score - want) < 0.02 * abs(want)
