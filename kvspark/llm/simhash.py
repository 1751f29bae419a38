"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint bit is set if it is set in over half of the hashes of the text's word shingles.
Fingerprints link at a few differing bits. Distinct fingerprints are dealt into groups that agree
in some blocks of bits, such that every pair within the radius meets in one group at least. The
groups of a task, one after the other and each sorted by Gray rank, which puts fingerprints with
long common bit patterns side by side, are indexed: single codes at the bottom, and upper nodes
that hold the bits all of their members share (below the root only those their parent does not
have). A search adds up the differences on the way down and leaves a node once they exceed the
radius, once it holds no member of the group, or once all of its members are known to be in the
component of the sought one. An index returns spanning links of its components, never all pairs.

Cases: null and empty texts, and texts without words, have fingerprint zero and link like any
other; repeated rows and copies are one fingerprint; a text of any length is read whole; a bit set
in just half of the hashes (a tie) is 0; a null id is never a component's id unless all ids of the
component are null; of a component's rows with the least id (ties) ``dedupe`` keeps that with the
least content hash, of identical rows one; an empty table gives no rows; ``near_duplicates``
returns its own three columns whatever others there are, and ``dedupe`` keeps all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, meet, split_hot
from .components import components

FAN = 8
#: Chunk of hashes whose bits are counted at once.
_CHUNK = 1 << 14


def shingles(text: bytes | None, n: int) -> list[bytes]:
    """Word n-grams, space-joined, repeats included; all words if they are fewer."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:z] for a, z in zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]


def fingerprint(text: bytes | None, n: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit."""
    parts = shingles(text, n)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _ragged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one after the other, and where each begins."""
    sizes = ends - begins
    cuts = np.cumsum(sizes) - sizes
    return np.repeat(begins - cuts, sizes) + np.arange(sizes.sum()), cuts


class _Forest:
    """Union-find over 0..n-1 with all labels kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if not len(pairs):
            return
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = root(x)
        self.label = to[self.label]


class GrayIndex:
    """Index of the fingerprints of many groups, for links within radius inside of each group.

    Groups lie one after the other, each in Gray order, under one tree. A node knows which groups
    it spans, so a search goes down into its own group only."""

    def __init__(self, codes: np.ndarray, radius: int, groups: np.ndarray | None = None):
        groups = np.zeros(len(codes), np.int64) if groups is None else groups
        order = np.lexsort((gray_rank(codes), groups))
        self.codes, self.groups, self.radius = codes[order], groups[order], radius
        #: Inner nodes left for their differences, and nodes left as their members are known.
        self.far, self.known = 0, 0
        n = len(codes)
        #: Levels from the single codes up: (first member of each node and n, bits that all members share beyond the parent's, their pattern, number of bits not shared).
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.arange(n)
        every = np.bitwise_and.reduceat(self.codes, starts)
        some = np.bitwise_or.reduceat(self.codes, starts)
        made = []
        while True:
            shared = ~(every ^ some)
            made.append((np.append(starts, n), shared, every & shared))
            if len(starts) == 1:
                break
            at = np.arange(0, len(starts), FAN)
            starts, every, some = starts[at], np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        for k, (s, shared, pattern) in enumerate(made):
            free = 64 - np.bitwise_count(shared).astype(np.int64)
            if k + 1 < len(made):
                above = np.repeat(made[k + 1][1], FAN)[: len(shared)]
                own = shared & ~above
            else:
                own = shared
            self.levels.append((s, own, pattern & own, free))

    def forest(self, chunk: int | None = None) -> np.ndarray:
        """The component label of each of self.codes. chunk: codes that search together."""
        codes, groups, radius, n = self.codes, self.groups, self.radius, len(self.codes)
        trees, chunk = _Forest(n), chunk or max(2048, n // 32)
        for begin in range(0, n, chunk):
            # Members from the chunk on suffice: earlier ones have asked for these already.
            q = np.arange(begin, min(n, begin + chunk))
            node, acc = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                starts, own, pattern, free = self.levels[k]
                acc = acc + np.bitwise_count((codes[q] ^ pattern[node]) & own[node])
                near = acc <= radius
                self.far += (len(near) - int(near.sum())) if k else 0
                near &= (groups[starts[node]] <= groups[q]) & (groups[starts[node + 1] - 1] >= groups[q]) & (starts[node + 1] > begin)
                q, node, acc = q[near], node[near], acc[near]
                if not len(q):
                    break
                touched, at = np.unique(node, return_inverse=True)
                members, cuts = _ragged(starts[touched], starts[touched + 1])
                least, most = (f.reduceat(trees.label[members], cuts)[at] for f in (np.minimum, np.maximum))
                known = (least == most) & (least == trees.label[q])
                self.known += int(known.sum())
                q, node, acc = q[~known], node[~known], acc[~known]
                whole = acc + free[node] <= radius  # all members are near, and near each other
                if whole.any():
                    w = np.unique(node[whole])
                    trees.link(_ragged(starts[w], starts[w + 1])[0], np.repeat(starts[w], starts[w + 1] - starts[w]))
                    trees.link(q[whole], starts[node[whole]])
                    q, node, acc = q[~whole], node[~whole], acc[~whole]
                if k:
                    below = len(self.levels[k - 1][0]) - 1
                    q, acc = np.repeat(q, FAN), np.repeat(acc, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, node, acc = q[node < below], node[node < below], acc[node < below]
        return trees.label

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Spanning links of the components."""
        first = self.codes[self.forest()]
        linked = first != self.codes
        return self.codes[linked], first[linked]


def block_masks(bits: list[int], blocks: int, agree: int) -> list[list[int]]:
    """Bit positions of every choice of agree of so many blocks of the given positions."""
    parts = [list(map(int, p)) for p in np.array_split(np.array(bits), blocks)]
    return [sorted(sum(c, [])) for c in combinations(parts, agree)]


def _gather(codes: np.ndarray, positions: list[int]) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k, p in enumerate(positions):
        out |= ((codes >> np.uint64(p)) & np.uint64(1)) << np.uint64(k)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _pairs_schema() -> T.StructType:
    return T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


#: Codes that a task's index takes, unless one group alone has more.
_INDEXED = 1 << 16


def _link_sorted(radius: int, pruned=None):
    """Partitions sorted by (part, key) -> spanning links inside of the groups, as they stream by.
    pruned: an accumulator for the number of nodes that searches left."""

    def index(parts: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = (keys[1:] == keys[:-1]) & (parts[1:] == parts[:-1])
        groups = np.concatenate(([0], np.cumsum(~same)))
        some = np.bincount(groups)[groups] > 1  # a group of one has no links
        if not some.any():
            return
        tree = GrayIndex(codes[some], radius, groups[some])
        u, v = tree.links()
        if pruned is not None:
            pruned.add(tree.far + tree.known)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            parts, keys, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(codes):
                continue
            held.append((parts, keys, codes.view(np.uint64)))
            if sum(len(x[0]) for x in held) < _INDEXED:
                continue
            parts, keys, codes = (np.concatenate(x) for x in zip(*held))
            cut = int(np.argmax((keys == keys[-1]) & (parts == parts[-1])))  # all before the last group is complete
            if cut:
                yield from index(parts[:cut], keys[:cut], codes[:cut])
            held = [(parts[cut:], keys[cut:], codes[cut:])]
        if held:
            yield from index(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(prints: DataFrame, scratch: Scratch, radius: int = 3, large: int = 1 << 17, pruned=None) -> DataFrame:
    """(fp) distinct signed 64-bit codes -> (u, v) spanning links of all pairs within radius.

    radius + 1 blocks, of which one agrees for every pair within the radius: groups of about 2**-16
    of evenly spread codes. Where these would be large, radius + 2 blocks, of which two agree:
    more groups a code, of about 2**-25. Either finds all links. Groups of over ``large`` codes
    are dealt again by blocks of their remaining bits, three of radius + 3; such a group agrees in
    so many bits that it can't hold more than some 2**24 distinct codes, 128 MB.
    """
    agree = 1 if prints.count() >> (64 // (radius + 1)) < large >> 5 else 2
    masks = block_masks(list(range(64)), radius + agree, agree)
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[_native_gather(F.col("fp"), m) for m in masks])).alias("part", "key"),
    ).select(F.col("part").cast("long").alias("part"), "key", "fp")
    big = scratch.save(keyed.groupBy("part", "key").count().where(F.col("count") > large).select("part", "key"), "big")
    rest = [[p for p in range(64) if p not in m] for m in masks]
    again = [block_masks(r, radius + 3, 3) for r in rest]

    def deal(batches):
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            codes = _unsigned(batch.column(2))
            for t in np.unique(parts):
                k, c = keys[parts == t], codes[parts == t]
                for s, m in enumerate(again[t]):
                    inner = _gather(c, m)  # some 20 bits
                    key = (k.view(np.uint64) << np.uint64(26) | inner).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c), t * 100 + s + 100)), pa.array(key), pa.array(c.view(np.int64))],
                        names=["part", "key", "fp"],
                    )

    if big.isEmpty():
        dealt = keyed
    else:
        schema = keyed.schema
        hot = keyed.join(big, ["part", "key"], "left_semi").select("part", "key", "fp").mapInArrow(deal, schema)
        cold = keyed.join(big, ["part", "key"], "left_anti").select("part", "key", "fp")
        dealt = cold.union(hot)
    found = dealt.repartition(F.col("part"), F.col("key")).sortWithinPartitions("part", "key").mapInArrow(_link_sorted(radius, pruned), _pairs_schema())
    return scratch.save(found, "found")


def _native_gather(code, positions: list[int]):
    """The bits at these positions, packed, as a column expression: one term a run of positions."""
    runs: list[list[int]] = []
    for p in positions:
        if runs and runs[-1][-1] == p - 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    out, done = F.lit(0).cast("long"), 0
    for r in runs:
        field = F.shiftrightunsigned(code, r[0]).bitwiseAND(F.lit((1 << len(r)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(field, done))
        done += len(r)
    return out


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, text_col: str = "text", keep=None) -> DataFrame:
    """docs with fp, the signed 64-bit fingerprint."""

    def make():
        def run(texts):
            codes = np.array([fingerprint(t, n, seed) for t in texts], np.uint64)
            return [pa.array(codes.view(np.int64))]

        return run

    return map_texts(docs, text_col, [T.StructField("fp", T.LongType())], make, keep)


def classes(rows: DataFrame, scratch: Scratch, radius: int = 3, pruned=None) -> DataFrame:
    """(fp, ident) -> (fp, n, component_id, root): the number of rows of a print, the least ident of
    all rows whose fp is reachable, and the print that names the component."""
    one = scratch.save(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("ident").alias("least")), "prints")
    found = links(one.select("fp"), scratch, radius, pruned=pruned)
    roots = components(found, scratch)
    named = one.join(roots, one.fp == roots.node, "left").select("fp", F.col("n").alias("rows"), "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = meet(named, scratch.save(least, "least"), "root")
    return scratch.save(named.select("fp", F.col("rows").alias("n"), "component_id", "root"), "classes")


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", pruned=None) -> DataFrame:
    """One row a document: id, fp, component_id. pruned: an accumulator for the number of index
    nodes that searches left."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, n, text_col=text_col, keep=[id_col]), "rows")
    named = classes(rows.select("fp", F.col(f"`{id_col}`").alias("ident")), scratch, radius, pruned).select("fp", "n", "component_id")
    return meet(rows, named, "fp").select(id_col, "fp", "component_id")


def dedupe(docs: DataFrame, n: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns. Of rows
    with this id the one with the least content hash stays, of identical rows one."""
    scratch = Scratch(docs.sparkSession, "simhash")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*named, F.xxhash64(ident, text).alias("rk"))
    slim = docs.select(ident.alias("ident"), F.xxhash64(ident, text).alias("rk"), text.alias("text"))
    rows = scratch.save(fingerprints(slim, n, text_col="text", keep=["ident", "rk"]), "rows")
    comp = classes(rows.select("fp", "ident"), scratch, radius)
    order = F.struct(F.col("ident").isNull(), F.col("ident"), F.col("rk"))
    full = meet(rows, comp.select("fp", "n", "root"), "fp")
    # The component is named by its root print: component_id may be null for several components.
    best = full.groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.rk").alias("rk"))
    copies = rows.groupBy("rk").agg(F.count("*").alias("n")).join(best.withColumn("kept", F.lit(True)), "rk", "left")
    # Rows that occur once and stay are most, so only the others are listed.
    marked = scratch.save(copies.where("kept is null or n > 1"), "marked")
    hot, cold = split_hot(marked, rows.count())
    others = keyed.join(F.broadcast(hot.select("rk")), "rk", "left_anti")
    single = others.join(cold.select("rk"), "rk", "left_anti")
    double = others.join(cold.where("kept").select("rk"), "rk", "left_semi")
    double = double.unionByName(keyed.join(F.broadcast(hot.where("kept").select("rk")), "rk", "left_semi")).dropDuplicates(["rk"])
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return single.select(back).unionByName(double.select(back))


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
