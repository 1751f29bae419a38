"""Chat formatting of reply trees, with DataFrame operations only.

Messages point to the message they reply to. Jump tables to the 2**k-th ancestor, each a self-join
of the one before, let every leaf list its path to the root in as many joins; branches of a tree
are ranked by the mean score of their messages, and each chosen path becomes one conversation:

    ### <role>: <text></turn>\\n      for every turn

Inside roles and texts a backslash becomes ``\\b``, ``#`` becomes ``\\h``, ``</turn>`` becomes
``\\l/turn>``, and in roles a colon becomes ``\\c``. The loss mask lists the code point spans of the
texts of one role.

Cases: null roles and texts are empty; repeated rows of a message id are one message (the least
row); a parent that does not exist makes a root; a cycle of replies raises; in ``by_turns`` repeated
rows and ties stay separate turns, ordered by turn, role and text, nulls first, and each row without
a conversation id is a conversation of its own; an empty table gives no rows; other columns are left
out, whatever their names; texts of any length are formatted whole, and a path is one row, as long
as its texts. Of branches with equal scores (ties) the one with the least leaf ranks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

END = "</turn>\n"
_MOST_JUMPS = 40


def escape(c: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("</turn>", "\\l/turn>"), *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """A backslash is always followed by its code letter, so codes can't overlap."""
    for plain, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent) -> (leaf, id, up): every message on the path of every leaf, up steps above it."""
    known = messages.select("id")
    jump = messages.select(F.col("id").alias("node"), F.col("parent").alias("id")).join(known, "id", "left_semi")
    jumps = []
    while True:
        jump = scratch.save(jump.select("node", "id"), f"jump{len(jumps)}")
        if jump.isEmpty():
            break
        jumps.append(jump)
        if len(jumps) > _MOST_JUMPS:
            raise ValueError("the replies hold a cycle")
        jump = jump.join(jump.select(F.col("node").alias("id"), F.col("id").alias("far")), "id").select("node", F.col("far").alias("id"))
    parents = messages.select(F.col("parent").alias("id")).where("id is not null").distinct()
    found = known.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        found = scratch.save(found, f"paths{k}")
        higher = found.join(jumps[k].select(F.col("node").alias("id"), F.col("id").alias("far")), "id")
        found = found.unionByName(higher.select("leaf", F.col("far").alias("id"), (F.col("up") + 2**k).alias("up")))
    return found


def format_trees(messages: DataFrame, best: int | None = 1, loss_role: str = "assistant", unique: bool = False) -> DataFrame:
    """(id, parent, tree, role, text, score) -> one row a chosen path: tree, leaf, rank, score,
    n_turns, formatted, loss_spans (start, end). best: paths of each tree, all if None. unique:
    no id occurs twice, so rows need not be compared."""
    scratch = Scratch(messages.sparkSession, "chat")
    columns = ["parent", "tree", "role", "text", "score"]
    once = messages.select(
        "id",
        "parent",
        "tree",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    if not unique:
        once = once.groupBy("id").agg(F.min(F.struct(*columns)).alias("m")).select("id", "m.*")
    once = scratch.save(once, "messages")
    on_path = scratch.save(paths(once.select("id", "parent"), scratch), "paths")
    ranked = on_path.join(once.select("id", "tree", "score"), "id").groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    chosen = on_path.join(ranked, "leaf")
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turns = chosen.join(once.select("id", "role", "text"), "id").select(
        "leaf", "tree", "rank", "score", (-F.col("up")).alias("at"), (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body")
    )
    # From here on all is by leaf: one exchange carries each text once.
    before = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("head") + F.char_length("body") + len(END)
    turns = turns.withColumn("start", (F.coalesce(F.sum(length).over(before), F.lit(0)) + F.char_length("head")).cast("long"))
    span = F.struct("start", (F.col("start") + F.char_length("body")).alias("end"))
    return (
        turns.groupBy("leaf")
        .agg(
            F.first("tree").alias("tree"),
            F.first("rank").alias("rank"),
            F.first("score").alias("score"),
            F.count("*").alias("n_turns"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("at", "head", "body"))), lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
            ).alias("formatted"),
            F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"),
        )
        .select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss_spans")
    )


def read_back(formatted: DataFrame, *keep: str) -> DataFrame:
    """(leaf, formatted, loss_spans) -> (leaf, columns keep, at, role, text, in_loss), a row a turn.

    Turns and mask spans of a row are listed together, turns are placed by the lengths before
    them, and a turn is under the mask if a span with just its begin and end stands beside it."""
    entry = lambda kind, at, piece, start, end: F.struct(
        kind.alias("kind"), at.cast("long").alias("at"), piece.alias("piece"), start.cast("long").alias("from"), end.cast("long").alias("to")
    )
    null = F.lit(None)
    turns = F.transform(F.split("formatted", END), lambda p, i: entry(F.lit(1), i, p, null, null))
    spans = F.transform("loss_spans", lambda s, i: entry(F.lit(0), i, null.cast("string"), s["start"], s["end"]))
    rows = formatted.repartition("leaf").select("leaf", *keep, F.explode(F.concat(spans, turns)).alias("e")).select("leaf", *keep, "e.*")
    upto = Window.partitionBy("leaf").orderBy("kind", "at").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("leaf").orderBy("start", "kind")
    role = F.substring_index(F.expr("substr(piece, 5)"), ": ", 1)
    beside = lambda c: F.lag(c).over(place)
    return (
        rows.where("kind = 0 or piece <> ''")
        .withColumn("begin", F.coalesce(F.sum(F.char_length("piece") + len(END)).over(upto), F.lit(0)))
        .withColumn("name", role)
        .withColumn("start", F.coalesce("from", F.col("begin") + 6 + F.char_length("name")))
        .withColumn("end", F.coalesce("to", F.col("begin") + F.char_length("piece")))
        .withColumn("in_loss", F.coalesce((beside("kind") == 0) & (beside("start") == F.col("start")) & (beside("end") == F.col("end")), F.lit(False)))
        .where("kind = 1")
        .select("leaf", *keep, "at", unescape(F.col("name")).alias("role"), unescape(F.expr("substr(piece, 7 + char_length(name))")).alias("text"), "in_loss")
    )


def by_turns(conversations: DataFrame) -> DataFrame:
    """Rows of turns as messages, each replying to the one before it in its conversation."""
    alone = F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), alone)
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", key.alias("key"), "turn", "role", "text").withColumn("n", F.row_number().over(order))
    name = lambda n: F.concat("key", F.lit("/"), n.cast("string"))
    return rows.select(
        name(F.col("n")).alias("id"),
        F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"),
        F.col("key").alias("tree"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


#: Both turns of the conversation that the query adds.
PROBE = "\\### Assistant: </turn> ok"


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    scratch = Scratch(spark, "chatquery")
    done = scratch.save(format_trees(by_turns(rows), unique=True), "formatted")
    turns = read_back(done.withColumn("chars", F.char_length("formatted").cast("long")), "tree", "chars")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda t: t["s"]), "")
    line = F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("s"))
    back = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"),
        F.first("chars").alias("formatted_chars"),
        F.count("*").alias("n_turns"),
        joined(line).alias("all"),
        joined(F.when(F.col("in_loss"), F.struct("at", F.col("text").alias("s")))).alias("loss"),
    )
    return back.select(
        F.expr("cast(if(tree like 'n%', null, substr(tree, 2)) as long)").alias("conv_id"),
        "n_turns",
        F.sha2("all", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '</turn>', '\l/turn>') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '</turn>', '\l/turn>'), ':', '\c') AS head FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
