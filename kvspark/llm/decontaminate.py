"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each pattern length the shift table
tells, for the block of words that ends at a position, how far the search may jump; a block with
shift 0 names a suffix-hash bucket, whose test strings (told apart by their first words) are
compared word by word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. In UTF-8 that is: runs
of ASCII digits, ASCII letters and bytes from 0x80 on.

Cases: a null or empty text has no words and is never contaminated; a null document id is carried
along; benchmark rows with a null id are an item named ``null``; rows of one item id form one item;
repeated windows and items count once, repeated documents each give a row; where several windows
hit the same words (ties) the words count once; texts of any length are read whole; an empty
benchmark contaminates nothing, an empty table of documents gives no rows; kept columns with the
name, in any case, of a new one give way to it, and ``clean`` keeps all columns of the documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts

#: Lower-cases A-Z; every byte that no word holds becomes a space.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """All windows of the item; an item of fewer words, but not none, is one window."""
    if 0 < len(item) < size:
        yield tuple(item)
    for i in range(len(item) - size + 1):
        yield tuple(item[i : i + size])


class WuManber:
    """Tables for patterns of one length, which are places in the items' words.

    Blocks of words are known by their hashes, so the tables do not hold them. A collision only
    shortens a jump or adds a comparison."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], length: int, block: int = 3):
        self.length = m = length
        self.block = b = min(block, m)
        self.far = m - b + 1
        #: All items' words, where each item begins in them, and its name.
        self.words: list[bytes] = []
        self.begins: list[int] = []
        self.names: list[str] = []
        #: Names of the other items of windows that several have.
        self.more: dict[int, list[str]] = {}
        self.shift: dict[int, int] = {}
        #: By the hash of the last block: a place, or, where there are several, places by the hash of the first.
        self.buckets: dict[int, int | dict[int, list[int]]] = {}
        known: dict[int | tuple[bytes, ...], int] = {}
        for name, row in items:
            begin = len(self.words)
            self.begins.append(begin)
            self.names.append(name)
            self.words.extend(row)
            for place, w in enumerate(windows(row, m), begin):
                same = known.setdefault(hash(w), place)
                if same is not place and tuple(self.words[same : same + m]) != w:
                    same = known.setdefault(w, place)  # its hash is another window's
                if same is place:
                    self._add(place, w)
                elif name not in (self.name(same), *self.more.get(same, ())[-1:]):
                    self.more.setdefault(same, []).append(name)

    def _add(self, place: int, w: tuple[bytes, ...]) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            part = hash(w[end - b : end])
            if m - end < self.shift.get(part, self.far):
                self.shift[part] = m - end
        tail = hash(w[m - b :])
        held = self.buckets.setdefault(tail, place)
        if held is place:
            return
        if isinstance(held, int):
            held = self.buckets[tail] = {hash(tuple(self.words[held : held + b])): [held]}
        held.setdefault(hash(w[:b]), []).append(place)

    def name(self, place: int) -> str:
        return self.names[bisect_right(self.begins, place) - 1]

    def owners(self, place: int) -> list[str]:
        return [self.name(place), *self.more.get(place, ())]

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, place of the pattern) of every occurrence."""
        shift, far, b, m, n = self.shift.get, self.far, self.block, self.length, len(text)
        end = m
        while end <= n:
            tail = hash(tuple(text[end - b : end]))
            step = shift(tail, far)
            if step:
                end += step
                continue
            start = end - m
            held = self.buckets[tail]
            places = (held,) if isinstance(held, int) else held.get(hash(tuple(text[start : start + b])), ())
            for p in places:
                if self.words[p : p + m] == text[start:end]:
                    yield start, p
            end += 1


def compile_items(items: Iterable[tuple[str, bytes | None]], size: int) -> list[WuManber]:
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    one: dict[bytes, bytes] = {}  # equal words are one object
    for name, text in items:
        row = [one.setdefault(w, w) for w in words(text)]
        if row:
            by_length.setdefault(min(len(row), size), []).append((name, row))
    return [WuManber(rows, m) for m, rows in sorted(by_length.items())]


def scan(tables: list[WuManber], text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words, and the items found."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for t in tables:
        places = set()
        for start, p in t.find(text):
            spans.append((start, start + t.length))
            places.add(p)
        for p in places:
            items.update(t.owners(p))
    return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", _SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _columns(counts: list[int], spans: list[list], names: list[list[str]], percent: int) -> list[pa.Array]:
    """Of number of words, merged spans and sorted items of each text."""
    hits = [sum(z - a for a, z in s) for s in spans]
    return [
        pa.array(counts, pa.int64()),
        pa.array(hits, pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
        pa.array([h > 0 and 100 * h >= percent * n for h, n in zip(hits, counts)], pa.bool_()),
        pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], _ARROW_SPAN),
        pa.array(names, pa.list_(pa.string())),
    ]


def _searcher(items, size: int, percent: int) -> Callable:
    """items: a broadcast block of items. Its tables stay with it in the worker, for further tasks."""

    def make():
        if not hasattr(items, "tables"):
            items.tables = compile_items(items.value, size)
        tables = items.tables

        def run(texts):
            rows = [words(t) for t in texts]
            found = [scan(tables, row) for row in rows]
            return _columns([len(r) for r in rows], [s for s, _ in found], [sorted(x) for _, x in found], percent)

        return run

    return make


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_mb: float) -> list:
    """Broadcasts of about block_mb of texts each, or of one item if that is longer; their tables
    take some 40 times as much. The benchmark's size is measured; a larger one is dealt into blocks
    by hash."""
    spark = benchmark.sparkSession
    rows = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    ).where("octet_length(text) > 0")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = int(total / (block_mb * 2**20)) + 1
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        got = sorted({(r[0], bytes(r[1])) for r in part.toLocalIterator()})
        out.append(spark.sparkContext.broadcast(got))
    return out


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    percent: int = 5,
    id_col: str = "item_id",
    item_text_col: str = "text",
    text_col: str = "text",
    keep: Iterable[str] | None = None,
    block_mb: float = 5,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word positions)
    and items. contaminated: some word is hit, and percent of all words at least.

    One pass over the documents, no shuffle. A benchmark of more than block_mb takes a pass a
    block; what the passes find is put together by row."""
    blocks = item_blocks(benchmark, id_col, item_text_col, block_mb)
    if len(blocks) == 1:
        return map_texts(docs, text_col, _FIELDS, _searcher(blocks[0], size, percent), keep)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in _FIELDS}]
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    rows = scratch.save(docs.select(*named, F.col(f"`{text_col}`").alias("t"), F.monotonically_increasing_id().alias("rid")), "rows")
    passes = []
    for k, block in enumerate(blocks):
        found = map_texts(rows, "t", _FIELDS, _searcher(block, size, percent), ["rid"])
        passes.append(scratch.save(found.select("rid", "n_words", "hit_spans", "items").where(F.lit(k == 0) | (F.col("n_hit") > 0)), f"pass{k}"))
    each = passes[0]
    for more in passes[1:]:
        each = each.unionByName(more)
    whole = each.groupBy("rid").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = rows.drop("t").join(whole, "rid").select(*[f"k{i}" for i in range(len(kept))], "n_words", "hit_spans", "items")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept] + _FIELDS)

    def finish(batches):
        for batch in batches:
            n = len(kept)
            counts, spans, names = (batch.column(n + i).to_pylist() for i in range(3))
            together = [merged((x["start"], x["end"]) for x in s) for s in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *_columns(counts, together, names, percent)], names=schema.names)

    return joined.mapInArrow(finish, schema)


#: Ids of hit rows that are broadcast, some 32 MB; more meet their rows in a shuffle.
_HIT_ROWS = 1 << 20


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    id_col: str = "item_id",
    item_text_col: str = "text",
    text_col: str = "text",
    block_mb: float = 5,
    together: int = _HIT_ROWS,
) -> DataFrame:
    """The documents without any benchmark window, with their own columns. A window is rarely there
    by chance, so that one in a long text is a leak like one in a short one.

    Of the passes over several blocks only the hit rows' numbers are kept, so texts stay where they
    are unless more than ``together`` rows are hit."""
    blocks = item_blocks(benchmark, id_col, item_text_col, block_mb)
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, back = f"c{docs.columns.index(text_col)}", [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if len(blocks) == 1:
        return map_texts(rows, text, _FIELDS, _searcher(blocks[0], size, 0)).where("n_hit = 0").select(back)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    passes = [
        scratch.save(map_texts(rows, text, _FIELDS, _searcher(block, size, 0), ["rid"]).where("n_hit > 0").select("rid"), f"hit{k}")
        for k, block in enumerate(blocks)
    ]
    hit = scratch.save(reduce(DataFrame.union, passes).distinct(), "hit")
    return rows.join(F.broadcast(hit) if hit.count() <= together else hit, "rid", "left_anti").select(back)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = search(docs, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: DuckDB. {docs} is the table of documents. Windows are joined as hashed word runs of each
#: length that occurs in the benchmark, then compared in full.
SQL = r"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pats AS (
  SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM {docs}
), runs AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pats) WHERE len(w) >= m)
), hits AS (
  SELECT r.rid, r.i, r.m, q.item FROM runs r JOIN pats q ON r.m = q.m AND r.p = q.p
), hit_words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
