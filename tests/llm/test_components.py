import numpy as np

from kvspark.llm.common import Scratch
from kvspark.llm.components import components, least_reachable


def plain(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in list(root) if top(x) != x)


def graphs():
    rng = np.random.default_rng(11)
    chain = [(k, k + 1) for k in rng.permutation(200).tolist()]
    hub = [(-5, 1000 + k) for k in range(1500)] + [(9999, 1000 + k) for k in range(0, 1500, 7)]
    loose = [tuple(x) for x in rng.integers(-(1 << 63), 1 << 63, (50, 2)).tolist()]
    mixed = [tuple(x) for x in (20_000 + rng.integers(0, 400, (300, 2))).tolist()]
    return chain + hub + loose + mixed + [(7, 7), (77_777, 77_777), (3, 4), (4, 3)]


def test_one_task_and_rounds_equal_plain_search(spark):
    links = graphs()
    want = plain(links)
    edges = spark.createDataFrame(links, "u long, v long")
    for together in (1 << 20, 0, 1200):
        got = components(edges, Scratch(spark, "t"), together=together).collect()
        assert sorted((r.node, r.root) for r in got) == want
    assert components(edges.where("u = v"), Scratch(spark, "t")).collect() == []
    assert components(edges.limit(0), Scratch(spark, "t"), together=0).collect() == []


def test_long_chains_in_one_task():
    at = np.random.default_rng(2).permutation(100_000)
    node, root = least_reachable(at[:-1], at[1:])
    assert sorted(node.tolist()) == list(range(1, 100_000)) and not root.any()
