"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text, prefix sums of c[j] * B**j modulo a Mersenne prime, for two bases
B, give the hash of any span in constant time. So spans of one text or of two compare without
reading them, and the longest common extension of two positions is found by binary search.

A fingerprint is the hash of the whole text and the least hashes of all of its spans of SPAN code
points (bottom-k sketch). The likeness of two fingerprints estimates the share of common spans
among all spans of both (Jaccard); it is exact for texts with few spans, and 1 for equal texts.

Cases: null text is empty; two empty texts are alike (1), an empty and another are not (0); texts
shorter than a span are one span, of any length are read whole; null ids come first in order; rows
of one id (ties) and repeated rows follow each other by the bytes of their texts, nulls first; a table of
one row is its own next; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_791_791_791)
SPAN = 16
KEPT = 64
#: Bytes of a text that tell its range, among rows of one id.
HEAD = 64
_VALUE_BITS = 40
_U = np.uint64
_P = _U(PRIME)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of the bases and of their inverses, as far as they were needed."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            m = len(self.up[0])
            for b, base in enumerate(BASES):
                self.up[b] = np.concatenate([self.up[b], _fold(self.up[b] * _U(pow(base, m, PRIME)))])
                self.down[b] = np.concatenate([self.down[b], _fold(self.down[b] * _U(pow(pow(base, m, PRIME), -1, PRIME)))])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix sums of a text; spans are [begin, begin + length)."""

    def __init__(self, points: np.ndarray, powers: _Powers, after: tuple[PrefixHash, int] | None = None):
        """after: another text and how many of its first code points come before these."""
        before, kept = after or (None, 0)
        self.n, self.powers = kept + len(points), powers
        powers.reach(self.n + 1)
        self.sums = []
        for b in range(len(BASES)):
            terms = _fold((points + _U(1)) * powers.up[b][kept : self.n])
            head = before.sums[b][: kept + 1] if before else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([head, _fold(np.cumsum(terms) + head[-1])]))

    def spans(self, length: int, begin: int = 0) -> np.ndarray:
        """62-bit hashes of all spans of this length that start at begin or later."""
        if length > self.n - begin:
            return np.zeros(0, np.uint64)
        out = None
        for b in range(len(BASES)):
            s = self.sums[b]
            x = _fold(s[begin + length :] + _P - s[begin : len(s) - length])
            x = _fold(x * self.powers.down[b][begin : self.n - length + 1])
            out = x if out is None else out << _U(31) | x
        return out

    def span(self, begin: int, length: int) -> tuple[int, ...]:
        return tuple(
            (int(self.sums[b][begin + length]) - int(self.sums[b][begin])) * int(self.powers.down[b][begin]) % PRIME for b in range(len(BASES))
        )

    def common(self, begin: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of two positions."""
        low, high = 0, min(self.n - begin, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(begin, mid) == other.span(at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> int:
        a, b = self.span(0, self.n)
        return a << 31 | b


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _least(values: np.ndarray) -> np.ndarray:
    """The KEPT least distinct values."""
    take = 2 * KEPT
    while True:
        part = values if len(values) <= take else np.partition(values, take - 1)[:take]
        out = np.unique(part)
        if len(out) >= KEPT or len(part) == len(values):
            return out[:KEPT]
        take *= 4


def _values(text: PrefixHash, begin: int = 0) -> np.ndarray:
    if 0 < text.n < SPAN:
        return _stir(text.spans(text.n)) >> _U(64 - _VALUE_BITS)
    return _stir(text.spans(SPAN, begin)) >> _U(64 - _VALUE_BITS)


def packed(text: PrefixHash, values: np.ndarray) -> bytes:
    """8 bytes of the whole text's hash, then 5 bytes of each of the least values."""
    return text.whole().to_bytes(8, "big") + values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def likeness(a: bytes | str, b: bytes | str) -> float:
    """Of two fingerprints, as bytes or hex digits."""
    a, b = (bytes.fromhex(f) if isinstance(f, str) else f for f in (a, b))
    if a == b:
        return 1.0
    x, y = ({f[i : i + 5] for i in range(8, len(f), 5)} for f in (a, b))
    union = sorted(x | y)[:KEPT]
    return sum(v in x and v in y for v in union) / len(union) if union else 0.0


def fingerprint(text: str, powers: _Powers | None = None) -> str:
    """Hex digits."""
    hashed = PrefixHash(codes(text), powers or _Powers())
    return packed(hashed, _least(_values(hashed))).hex()


class _Document:
    __slots__ = ("ident", "text", "points", "hashed", "values", "print")

    def __init__(self, ident, text: bytes | None, powers: _Powers):
        self.ident, self.text = ident, (text or b"").decode("utf-8", "replace")
        self.points = codes(self.text)
        self.hashed = PrefixHash(self.points, powers)
        self.values = _values(self.hashed)
        self.print = packed(self.hashed, _least(self.values))


def compare(doc: _Document, follower: _Document, powers: _Powers) -> tuple:
    """The columns that need the next document. The edited text shares the sums and the spans of
    what is kept of the text."""
    n = doc.hashed.n
    cut = n // 4
    kept = n - cut
    edited = PrefixHash(follower.points[:cut], powers, (doc.hashed, kept))
    if kept >= SPAN and edited.n >= SPAN:
        fresh = kept - SPAN + 1
        values = np.concatenate([_least(doc.values[:fresh]), _values(edited, fresh)])
    else:
        values = _values(edited)
    edited_print = packed(edited, _least(values))
    edited_text = doc.text[:kept] + follower.text[:cut]
    return (
        hashlib.sha256(edited_text.encode("utf-8", "replace")).digest(),
        edited_print,
        likeness(doc.print, edited_print),
        likeness(doc.print, follower.print),
        doc.hashed.common(0, edited, 0),
    )


#: prints holds both fingerprints, which share most of their values, one after the other.
_NAMES = ["doc_id", "n_chars", "sha", "prints", "edited_at", "near_edited", "near_next", "common_prefix"]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
_SCHEMA = "doc_id long, n_chars long, sha binary, prints binary, edited_at int, near_edited double, near_next double, common_prefix long"


def _row(doc: _Document, follower: _Document, powers: _Powers) -> tuple:
    sha, edited, near_edited, near_next, common = compare(doc, follower, powers)
    return doc.ident, doc.hashed.n, sha, doc.print + edited, len(doc.print), near_edited, near_next, common


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    Documents are range-partitioned and sorted, once; a task compares neighbours as they stream by.
    Only the first and the last text of each partition go on, to meet across partitions."""
    scratch = Scratch(docs.sparkSession, "prefixhash")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    # Ranges end between heads of texts, whose order is that of the texts, so rows of one id that
    # lie in several partitions are in order too.
    ordered = texts.repartitionByRange("id", F.substring("text", 1, HEAD)).sortWithinPartitions("id", "text")

    def run(batches):
        """place 0: a finished row; 1: the partition's last document, 2: its first one."""
        powers, part = _Powers(), TaskContext.get().partitionId()
        first = last = None

        def batch_of(rows, place, text):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
            more = [pa.array([part] * len(rows), pa.int64()), pa.array([place] * len(rows), pa.int32()), pa.array([text] * len(rows), pa.binary())]
            return pa.RecordBatch.from_arrays(columns + more, names=[*_NAMES, "part", "place", "text"])

        for batch in batches:
            done = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = _Document(ident, text, powers)
                if last is None:
                    first = (ident, text)
                else:
                    done.append(_row(last, doc, powers))
                last, last_text = doc, text
            if done:
                yield batch_of(done, 0, None)
        if last is not None:
            for place, (ident, text) in ((2, first), (1, (last.ident, last_text))):
                yield batch_of([(ident, *[None] * 7)], place, text or b"")

    seen = scratch.save(ordered.mapInArrow(run, _SCHEMA + ", part long, place int, text binary"), "seen", compression="zstd")
    firsts = seen.where("place = 2").select("part", F.col("text").alias("next_text"))
    parts = Window.orderBy("part")  # a number a partition
    follows = firsts.select("part").select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    ends = (
        seen.where("place = 1")
        .select("part", "doc_id", "text")
        .join(follows, "part")
        .join(firsts.withColumnRenamed("part", "next"), "next")
        .select("doc_id", "text", "next_text")
    )

    def meet(batches):
        powers = _Powers()
        for batch in batches:
            rows = [_row(_Document(i, a, powers), _Document(None, b, powers), powers) for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    rows = seen.where("place = 0").select(*_NAMES).unionByName(ends.mapInArrow(meet, _SCHEMA))
    digits = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id",
        "n_chars",
        digits("sha").alias("edited_sha256"),
        digits(F.expr("substring(prints, 1, edited_at)")).alias("fingerprint"),
        digits(F.expr("substring(prints, edited_at + 1)")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "common_prefix",
    )


def query(docs: DataFrame) -> DataFrame:
    return with_next(docs)
