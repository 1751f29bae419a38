import hashlib
import random

import numpy as np

from kvspark.llm import prefixhash as ph

SF = "/root/testdata/sf0.01"


def brute(rows):
    """rows in order -> what the exact columns should be, and the likeness of whole span sets."""

    def spans(t):
        return {t[i : i + ph.SPAN] for i in range(max(1, len(t) - ph.SPAN + 1))} if t else set()

    def jaccard(a, b):
        return 1.0 if a == b else len(spans(a) & spans(b)) / max(1, len(spans(a) | spans(b)))

    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        common = next((j for j, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ph.fingerprint(t), ph.fingerprint(edited), jaccard(t, edited), jaccard(t, after), common))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0], r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*r[:5], r[7]) for r in got] == [(*r[:5], r[7]) for r in want]
    gap = np.array([[g[5] - w[5], g[6] - w[6]] for g, w in zip(got, want)])
    assert np.abs(gap).max() < 0.35 and np.abs(gap).mean() < 0.06


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = [tuple(r) for r in ph.query(docs).collect()]
    close(got, brute(rows))
    assert np.mean([r[5] for r in got if r[1] > 200]) > 0.45 > 0.1 > np.mean([r[6] for r in got if r[1] > 200])


def test_spans_and_common_extensions():
    rng = random.Random(2)
    powers = ph._Powers()
    a = "".join(rng.choice("ab") for _ in range(300))
    b = a[:120] + "x" + a[50:250] + "é😀"
    x, y = (ph.PrefixHash(ph.codes(t), powers) for t in (a, b))
    for _ in range(2000):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert x.common(i, y, j) == common
    spliced = ph.PrefixHash(ph.codes(b[100:]), powers, (x, 100))
    straight = ph.PrefixHash(ph.codes(a[:100] + b[100:]), powers)
    assert all((s == t).all() for s, t in zip(spliced.sums, straight.sums)) and (spliced.spans(7) == straight.spans(7)).all()


def test_cases(spark):
    long = "abcdefg hijk lmnop " * 20000
    rows = [(2, None), (3, ""), (3, "zz"), (3, "zz"), (5, long), (None, "first of all"), (7, "é" * 9), (8, "short text of some words here")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, near_next double")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for parts in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        close([tuple(r) for r in ph.query(docs).collect()], brute(order))
    tied = [(1, f"{'same head ' * (k % 2 * 9)}{k * 7919 % 97} text") for k in range(60)] + [(0, "a"), (2, None)]
    docs2 = spark.createDataFrame([(i, t, 1.0) for i, t in tied], "doc_id long, text string, near_next double")
    for parts in ("1", "5", "16"):  # one id over several partitions
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        close([tuple(r) for r in ph.query(docs2).collect()], brute(sorted(tied, key=lambda r: (r[0], r[1] or ""))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = ph.query(docs.where("doc_id = 7")).collect()
    assert [tuple(r) for r in one] == brute([(7, "é" * 9)])
    assert ph.query(docs.limit(0)).collect() == []
    assert ph.likeness(ph.fingerprint(""), ph.fingerprint("")) == 1 and ph.likeness(ph.fingerprint(""), ph.fingerprint("a")) == 0
