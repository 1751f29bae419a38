import numpy as np
import xxhash
from pyspark.sql import functions as F

from kvspark.llm import simhash

SF = "/root/testdata/sf0.01"


def brute_components(codes, idents, radius=3):
    codes = np.array(codes, np.uint64)
    label = list(range(len(codes)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(codes)):
        least.setdefault(root(i), []).append(idents[i])
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(codes))]


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    comps = brute_components(prints, [r.doc_id for r in rows])
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, comps))
    got = sorted(map(tuple, simhash.query(docs).collect()))
    assert got == want
    assert len(set(comps)) < len(rows)


def test_cases(spark):
    long = "word " * 30000 + "end"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "A b", "x"), (4, "A b", "x"), (None, "a B", "x"), (6, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(docs).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= got
    assert len({f for i, f, c in got if i in (4, None)}) == 1 and {c for i, f, c in got if i in (4, None)} == {4}
    assert simhash.query(docs.limit(0)).collect() == []
    kept = simhash.dedupe(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.fp) for r in kept.collect()) == [(1, "x"), (4, "x"), (6, None)]
    nulls = spark.createDataFrame([(None, "p q r s"), (None, "p q r s"), (None, None)], "doc_id long, text string")
    assert sorted(r.text or "" for r in simhash.dedupe(nulls).collect()) == ["", "p q r s"]


def test_index_and_second_deal(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = base[rng.integers(0, 40, 1500)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    codes = np.unique(codes)
    comps = brute_components(codes, [int(c) for c in codes])
    signed = codes.view(np.int64).tolist()
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    from kvspark.llm.common import Scratch
    from kvspark.llm.components import components

    for large in (1 << 17, 5, 40):  # 40: wide groups, of which the largest are dealt again
        scratch = Scratch(spark, "t")
        root = {r.node: r.root for r in components(simhash.links(prints, scratch, large=large), scratch).collect()}
        groups, want = {}, {}
        for s, c in zip(signed, comps):
            groups.setdefault(root.get(s, s), set()).add(s)
            want.setdefault(c, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    u, v = simhash.GrayIndex(codes, 3).links()
    assert (np.bitwise_count(u ^ v) <= 64).all() and len(u) == len(codes) - len(set(comps))


def test_query_goes_through_the_index(spark):
    """Over a larger table: the index is built, leaves nodes, and the links are those of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pruned = spark.sparkContext.accumulator(0)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs, pruned=pruned).collect()}
    assert pruned.value > 10_000
    idents = sorted(got)
    codes = [got[i][0] % (1 << 64) for i in idents]
    assert brute_components(codes, idents) == [got[i][1] for i in idents]


def test_index_of_many_groups():
    rng = np.random.default_rng(5)
    codes = np.concatenate([np.unique(rng.integers(0, 1 << 6, 20, dtype=np.uint64)) << np.uint64(s) for s in rng.integers(0, 50, 300)])
    groups = rng.integers(0, 90, len(codes))
    _, at = np.unique(np.stack([groups.astype(np.uint64), codes]), axis=1, return_index=True)
    codes, groups = codes[at], groups[at]
    tree = simhash.GrayIndex(codes, 2, groups)
    label = tree.forest(chunk=64)
    for g in range(90):
        mine = tree.groups == g
        comps = brute_components(tree.codes[mine], list(np.flatnonzero(mine)), 2)
        assert label[mine].tolist() == comps
    assert tree.far and tree.known


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert prints[0] != prints[1] and (prints[0] ^ prints[1]).bit_count() <= 3
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, "p q r s")], "doc_id long, text string")
    assert sorted(len(r.text) for r in simhash.dedupe(docs).collect())[0] == 7
    assert simhash.dedupe(docs).count() == 2
