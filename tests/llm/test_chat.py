import pytest

from kvspark.llm import chat

from .sqlcheck import equal

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    assert equal(chat.query(spark.read.parquet(f"{SF}/conversations.parquet")), chat.SQL, SF)


def test_query_runs_no_python(spark):
    df = chat.query(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TREE = [
    # id, parent, tree, role, text, score
    ("r", None, "t", "user", "root", 1.0),
    ("a", "r", "t", "assistant", "a: # </turn>\n \\b \\l", 5.0),
    ("b", "r", "t", "assistant", "b", 1.0),
    ("a1", "a", "t", "user", None, 0.0),
    ("a2", "a", "t", "user", "a2", 9.0),
    ("a2x", "a2", "t", None, "end", 9.0),
    ("lost", "nowhere", "u", "we:ird #", "x", None),
]
SCHEMA = "id string, parent string, tree string, role string, text string, score double"


def test_tree_paths_and_ranks(spark):
    messages = spark.createDataFrame([*TREE, TREE[0]], SCHEMA)
    got = {(r.tree, r.leaf): r for r in chat.format_trees(messages, best=None).collect()}
    assert {k: (r.rank, r.n_turns) for k, r in got.items()} == {("t", "a2x"): (1, 4), ("t", "a1"): (2, 3), ("t", "b"): (3, 2), ("u", "lost"): (1, 1)}
    top = got["t", "a2x"]
    assert top.formatted == "### user: root</turn>\n### assistant: a: \\h \\l/turn>\n \\bb \\bl</turn>\n### user: a2</turn>\n### : end</turn>\n"
    assert [top.formatted[s.start : s.end] for s in top.loss_spans] == ["a: \\h \\l/turn>\n \\bb \\bl"]
    one = chat.format_trees(messages, best=1)
    assert {r.leaf for r in one.collect()} == {"a2x", "lost"}
    back = [tuple(r) for r in chat.read_back(one).orderBy("leaf", "at").collect()]
    by = {t[0]: t for t in TREE}
    want = [("a2x", i, by[x][3] or "", by[x][4] or "", by[x][3] == "assistant") for i, x in enumerate(["r", "a", "a2", "a2x"])]
    assert back == [*want, ("lost", 0, "we:ird #", "x", False)]


def test_long_chain_and_cycle(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(700)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_trees(chat.by_turns(conv)).collect()
    assert len(done) == 1 and done[0].n_turns == 700 and len(done[0].loss_spans) == 350
    ring = spark.createDataFrame([("a", "b", "t", "u", "x", 0.0), ("b", "a", "t", "u", "x", 0.0)], SCHEMA)
    limit, chat._MOST_JUMPS = chat._MOST_JUMPS, 4
    try:
        with pytest.raises(ValueError):
            chat.format_trees(ring)
    finally:
        chat._MOST_JUMPS = limit


def test_cases(spark):
    long = "word " * 100000
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, None, None, "n", 1), (None, 2, "assistant", "é" * 3, 1), (None, 1, "user", "q", 1), (3, 1, "assistant", long, 1), (4, 0, "assistant", "", 1)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    found = chat.query(conv).collect()
    got = {r.conv_id: r for r in found}
    assert set(got) == {1, None, 3, 4, -7}
    assert sorted((r.n_turns, r.loss_chars) for r in found if r.conv_id is None) == [(1, 0), (1, 3)]  # not one conversation of all such rows
    assert got[1].n_turns == 3 and got[3].loss_chars == len(long) and got[4].loss_chars == 0
    assert got[-7].loss_chars == len(chat.PROBE)
    assert [r.conv_id for r in chat.query(conv.limit(0)).collect()] == [-7]
