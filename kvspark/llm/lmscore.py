"""Language-model scores from a log-frequency Bloom filter.

N-grams of all training documents are counted exactly, by their 64-bit hashes, in shards of the
hash range. Counts are quantised on a logarithmic scale; an n-gram of level q enters the filter as
q items (n-gram, 1) .. (n-gram, q). A shard fills its own block of the filter, whose size follows
its items at fixed bits an item, so none stays out. A count is read back by probing levels until
one is missing; probabilities interpolate the n-gram estimates down to the smoothed unigram.

The filter is never held as a whole: documents are dealt to units, and the distinct n-grams of a
unit meet the blocks in the shards. Single tokens have exact counts: those of at most ``frequent``
tokens are broadcast, the others are looked up in the shards too.

Cases: null and empty texts are one end token; a null id counts as empty text when folds are dealt;
repeated rows count and score as often as they occur; counts on the edge of two levels (ties) are
of the upper one; texts of any length are read whole; without training documents all counts are 0;
an empty table gives no rows; a kept column with the name, in any case, of a new one gives way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, as_bytes, slices

_BEGIN, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_U = np.uint64
#: Text whose n-grams make a shard, for a task to hold as a whole.
SHARD_MB = 12
#: Tasks that shards are dealt to at most. A task takes its shards one after the other, sorted, so
#: more of them cost it time and disk, but no memory.
MOST_TASKS = 1 << 16
#: Keys held by a counting task before they are sorted and sent off.
_HELD = 1 << 21
#: Text of the documents that ask the shards together.
UNIT_BYTES = 6 << 20


def stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing permutation."""
    x = x ^ (x >> _U(33))
    x *= _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words, then the end."""
    found = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    out[-1] = _END
    return out


def ngrams(ids: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each token; histories reach back to a begin mark.
    starts: positions at which texts begin. Order 1 gives the token's own key."""
    key = stir(ids)
    back = ids
    for n in range(2, order + 1):
        back = np.concatenate(([_BEGIN], back[:-1]))
        back[starts] = _BEGIN
        key = stir(key + back * _U(2 * n + 1) + _U(n))
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the leading bits, so that sorted keys come in shard order."""
    return ((keys >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the shards that occur, in order."""
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)])


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """By shard, as many shards to each task as to any other."""
    n = min(max(1, shards), MOST_TASKS)
    return rows.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int"))


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, for the codec of the shuffle to find the zeros."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(blob: bytes, n: int, at: int, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(kind).ravel()


def gaps(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys; their running sum gives the keys back."""
    return np.diff(keys, prepend=_U(0))


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys counted once need no count."""
    more = counts > 1
    head = np.array([len(keys) - more.sum(), more.sum()], np.int64)
    return head.tobytes() + squeeze(gaps(keys[~more])) + squeeze(gaps(keys[more])) + squeeze(counts[more].astype(np.int64))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    one, more = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    keys = [np.cumsum(unsqueeze(blob, n, at), dtype=np.uint64) for n, at in ((one, 16), (more, 16 + 8 * one))]
    counts = unsqueeze(blob, more, 16 + 8 * (one + more), np.int64)
    return np.concatenate(keys), np.concatenate([np.ones(one, np.int64), counts])


class Levels:
    """Counts on a logarithmic scale: level 1 is count 1, each further one a factor more."""

    def __init__(self, factor: float = 1.5):
        self.factor = factor

    def of(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(counts) / math.log(self.factor) + 1e-9).astype(np.int64)

    def count(self, levels: np.ndarray) -> np.ndarray:
        """The middle, on that scale, of the counts of a level; level 0 is count 0."""
        low = np.ceil(self.factor ** (levels - 1.0) - 1e-6)
        high = np.maximum(low, np.ceil(self.factor ** (levels * 1.0) - 1e-6) - 1)
        return np.where(levels > 0, np.sqrt(low * high), 0.0)


class LogBloom:
    """The filter: shards blocks of block_bytes each."""

    def __init__(self, bits: np.ndarray, shards: int, block_bytes: int, hashes: int, levels: Levels):
        self.bits, self.shards, self.block_bytes, self.hashes, self.levels = bits, shards, block_bytes, hashes, levels

    def places(self, keys: np.ndarray, level) -> Iterator[np.ndarray]:
        """Bit positions within the block, for each hash function."""
        a = stir(keys ^ (_U(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)))
        step = (a >> _U(32)) | _U(1)
        low, size = a & _U(0xFFFFFFFF), _U(self.block_bytes * 8)
        for i in range(self.hashes):
            yield (((low + _U(i) * step) & _U(0xFFFFFFFF)) * size) >> _U(32)

    @staticmethod
    def bytes_for(counts: np.ndarray, hashes: int, levels: Levels) -> int:
        """Of a block that leaves none of these out."""
        items = int(levels.of(counts).sum()) if len(counts) else 0
        return max(8, math.ceil((items + 1) * hashes / math.log(2) / 64) * 8)

    @staticmethod
    def block(keys: np.ndarray, counts: np.ndarray, block_bytes: int, hashes: int, levels: Levels) -> bytes:
        """A shard's block, at most about half of its bits set."""
        own = LogBloom(np.zeros(block_bytes, np.uint8), 1, block_bytes, hashes, levels)
        depth = levels.of(counts) if len(counts) else counts
        room = block_bytes * 8 * math.log(2) / hashes
        if depth.sum() > room:
            order = np.argsort(-counts, kind="stable")
            full = np.cumsum(depth[order]) > room
            least = counts[order][np.argmax(full)]
            keys, depth = keys[counts > least], depth[counts > least]
        level = 0
        flat = np.zeros(block_bytes * 8, bool)
        while len(keys):
            level += 1
            for at in own.places(keys, level):
                flat[at] = True
            keys, depth = keys[depth > level], depth[depth > level]
        return np.packbits(flat, bitorder="little").tobytes()

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts."""
        return self.levels.count(self.level(keys))

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Estimated levels, 0 for keys that are not in."""
        found = np.zeros(len(keys), np.int64)
        base = shard_of(keys, self.shards) * self.block_bytes
        live, level = np.arange(len(keys)), 0
        while len(live):
            level += 1
            at, hit = base[live], np.ones(len(live), bool)
            for place in self.places(keys[live], level):
                hit &= (self.bits[at + (place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)
            live = live[hit]
            found[live] = level
        return found


def _binary(rows: list) -> pa.Array:
    return pa.array(rows, pa.large_binary() if sum(map(len, rows)) > 2**31 - 1 else pa.binary())


_SENT = "shard long, kind int, blob binary"


def count_shards(docs: DataFrame, order: int, shards: int, text_col: str) -> DataFrame:
    """(shard, kind, blob): packed counts; kind 1: tokens, 2: longer n-grams."""

    def run(batches):
        held: dict[int, list] = {1: [], 2: []}

        def flush(kind: int):
            if not held[kind]:
                return
            keys, counts = tally(np.concatenate(held[kind]))
            held[kind].clear()
            rows = [(s, pack(keys[a:z], counts[a:z])) for s, a, z in runs(shard_of(keys, shards))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                names=["shard", "kind", "blob"],
            )

        for batch in (part for whole in batches for part in slices(whole, 0)):
            each = [tokens(t) for t in as_bytes(batch.column(0))]
            ids = np.concatenate(each)
            starts = np.concatenate(([0], np.cumsum([len(x) for x in each])[:-1]))
            held[1].append(ngrams(ids, starts, 1))
            for n in range(2, order + 1):
                held[2].append(ngrams(ids, starts, n))
            for kind in (1, 2):
                if sum(map(len, held[kind])) >= _HELD:
                    yield from flush(kind)
        yield from flush(1)
        yield from flush(2)

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, _SENT)


def fill_shards(sent: DataFrame, shards: int, hashes: int, levels: Levels) -> DataFrame:
    """(shard, vocab, block, distinct, total, hist): exact token counts of the shard, its block of
    the filter with all longer n-grams, and how many tokens have counts of so many binary digits."""

    def run(batches):
        now, held = None, []

        def flush():
            if now is None:
                return
            words = [unpack(b) for k, b in held if k == 1]
            rest = [unpack(b) for k, b in held if k == 2]
            held.clear()
            empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            keys, counts = tally(*(np.concatenate(x) for x in zip(empty, *words)))
            more, most = tally(*(np.concatenate(x) for x in zip(empty, *rest)))
            block = LogBloom.block(more, most, LogBloom.bytes_for(most, hashes, levels), hashes, levels)
            digits = np.frexp(counts.astype(np.float64))[1] if len(counts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([now], pa.int64()),
                    pa.array([keys.tobytes() + counts.tobytes()], pa.binary()),
                    pa.array([block], pa.binary()),
                    pa.array([len(keys)], pa.int64()),
                    pa.array([int(counts.sum())], pa.int64()),
                    pa.array([np.bincount(digits, minlength=64).tolist()], pa.list_(pa.int64())),
                ],
                names=["shard", "vocab", "block", "distinct", "total", "hist"],
            )

        for batch in batches:
            for shard, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != now:
                    yield from flush()
                    now = shard
                held.append((kind, blob))
        yield from flush()

    schema = "shard long, vocab binary, block binary, distinct long, total long, hist array<long>"
    return dealt(sent, shards).sortWithinPartitions("shard").mapInArrow(run, schema)


class Model:
    """What a scoring task gets."""

    def __init__(self, keys, counts, order: int, total: int, distinct: int, ends: int, prior: float):
        self.keys, self.counts, self.order = keys, counts, order
        self.total, self.distinct, self.ends, self.prior = total, distinct, float(ends), prior

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of frequent tokens, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], -1)

    def log10(self, counts: np.ndarray, longer: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Of each token's probability given its history, from the counts of the tokens and of the
        n-grams of order 2, 3, .. that end at them."""
        p = self.unigram(counts)
        for seen in longer:
            # What precedes: the (n-1)-gram that ends at the token before; at a text's start its
            # count is unknown, the number of ends stands for it.
            before = np.concatenate(([0.0], counts[:-1]))
            before[starts] = self.ends
            p = (np.minimum(seen, before) + self.prior * p) / (before + self.prior)
            counts = seen
        return np.log10(p)


class Unit:
    """Documents that ask the shards together: their tokens and distinct n-grams."""

    def __init__(self, each: list[np.ndarray], model: Model):
        self.sizes = np.array([len(x) for x in each])
        ids = np.concatenate(each)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.words, self.back = np.unique(ngrams(ids, self.starts, 1), return_inverse=True)
        self.exact = model.exact(self.words)
        grams = [ngrams(ids, self.starts, n) for n in range(2, model.order + 1)]
        self.grams, back = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.longer = np.split(back, len(grams)) if grams else []

    def questions(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, blob): rare tokens and n-grams of the shard."""
        rare = self.words[self.exact < 0]
        found = [{s: keys[a:z] for s, a, z in runs(shard_of(keys, shards))} for keys in (rare, self.grams)]
        for s in sorted(found[0].keys() | found[1].keys()):
            asked = [x.get(s, rare[:0]) for x in found]
            yield s, np.array([len(x) for x in asked], np.int64).tobytes() + b"".join(squeeze(gaps(x)) for x in asked)

    def score(self, answers: list[bytes], model: Model, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """answers: of the shards in order. Known tokens, base score and score of each document."""
        counts, found = self.exact.copy(), []
        rare = []
        for blob in answers:
            n, more = np.frombuffer(blob, np.int64, 2)
            rare.append(unsqueeze(blob, int(n), 16, np.int64))
            found.append(np.frombuffer(blob, np.uint8, more, 16 + 8 * n))
        counts[counts < 0] = np.concatenate([np.zeros(0, np.int64), *rare])
        seen = levels.count(np.concatenate([np.zeros(0, np.uint8), *found]).astype(np.int64))
        base = np.log10(model.unigram(counts))[self.back]
        counts = counts[self.back]
        full = model.log10(counts.astype(np.float64), [seen[x] for x in self.longer], self.starts)
        return tuple(np.add.reduceat(x, self.starts) for x in ((counts > 0).astype(np.int64), base, full))


def answer(blob: bytes, keys: np.ndarray, counts: np.ndarray, bloom: LogBloom | None) -> bytes:
    """Exact counts of the tokens asked for, levels (a byte each) of the n-grams."""
    n, more = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    words, grams = (np.cumsum(unsqueeze(blob, k, at), dtype=np.uint64) for k, at in ((n, 16), (more, 16 + 8 * n)))
    c = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        c = np.where(keys[at] == words, counts[at], 0)
    found = bloom.level(grams) if bloom else np.zeros(more, np.int64)
    return blob[:16] + squeeze(c) + np.minimum(found, 255).astype(np.uint8).tobytes()


def score(
    docs: DataFrame,
    training: DataFrame,
    order: int = 2,
    filter_mb: int = 64,
    frequent: int = 1 << 20,
    hashes: int = 4,
    prior: float = 1000.0,
    keep=("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """docs (columns keep) with n_tokens, n_known, train_tokens, base_score, score.

    filter_mb bounds a shard's block of the filter, frequent the broadcast exact counts (16 bytes
    each). Shards follow the bytes of the training texts: SHARD_MB each, 16 at least, and so many
    that the blocks keep to their bound. No n-gram is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lmscore")
    size, ends = training.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long")), F.count("*")).head()
    size = size or 0
    # A word takes two bytes of text at least, and c equal n-grams at most about c items.
    most_mb = (order - 1) * (size / 2 + ends) * 1.4 * hashes / math.log(2) / 8 / 2**20
    shards = max(16, -(-size // (SHARD_MB << 20)), math.ceil(most_mb / filter_mb))
    levels = Levels()
    filled = fill_shards(count_shards(training, order, shards, text_col), shards, hashes, levels)
    filled = scratch.save(filled, "shards")
    total, distinct = filled.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).head()
    digits = dict(filled.select(F.posexplode("hist").alias("d", "n")).groupBy("d").agg(F.sum("n")).collect())
    least, sum_n = 64, 0
    while least > 0 and sum_n + digits.get(least - 1, 0) <= frequent:
        least -= 1
        sum_n += digits.get(least, 0)

    def frequents(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = len(blob) // 16
                keys, counts = np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)
                often = np.frexp(counts.astype(np.float64))[1] >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[often].tobytes() + counts[often].tobytes()], pa.binary())], names=["blob"])

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in filled.select("vocab").mapInArrow(frequents, "blob binary").collect():
        n = len(r.blob) // 16
        keys.append(np.frombuffer(r.blob, np.uint64, n))
        counts.append(np.frombuffer(r.blob, np.int64, n, 8 * n))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order_of = np.argsort(keys)
    factor = levels.factor
    #: Plain values, so that workers can read them without this package.
    sent = spark.sparkContext.broadcast((keys[order_of], counts[order_of]))
    del keys, counts

    def receive() -> Model:
        return Model(*sent.value, order, int(total), int(distinct), int(ends), prior)

    keep = [c for c in keep if c.lower() not in {"n_tokens", "n_known", "train_tokens", "base_score", "score"}]
    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]

    def deal(batches):
        """(unit, shard, blob): the documents of each unit as one row, without a shard."""
        unit, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            held.clear()
            blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.nulls(1, pa.int64()), blob], names=names)

        for batch in batches:
            since = 0
            for i, t in enumerate(as_bytes(batch.column(len(keep)))):
                size += 1 + len(t or b"")
                if size >= UNIT_BYTES:
                    held.append(batch.slice(since, i + 1 - since))
                    yield flush()
                    unit, size, since = unit + 1, 0, i + 1
            if since < batch.num_rows:
                held.append(batch.slice(since))
        if held:
            yield flush()

    def opened(blob: bytes, m: Model) -> tuple[pa.Table, Unit]:
        rows = pa.ipc.open_stream(blob).read_all()
        return rows, Unit([tokens(t) for c in rows.column(len(keep)).chunks for t in as_bytes(c)], m)

    def ask(batches):
        """The questions of the units to the shards."""
        m = receive()
        for batch in batches:
            for unit, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2))):
                rows = list(opened(blob, m)[1].questions(shards))
                for a in range(0, len(rows), 1000):
                    part = list(zip(*rows[a : a + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array([unit] * len(part[0]), pa.int64()), pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary())], names=names)

    names = ["unit", "shard", "blob"]
    schema = "unit long, shard long, blob binary"
    texts = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    first = scratch.save(texts.mapInArrow(deal, schema), "first")

    def meet(batches):
        """Of each shard its token counts, its block, then the questions."""
        now, keys, counts, bloom = None, None, None, None
        for batch in batches:
            out: list = []
            for shard, kind, unit, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != now:
                    now, keys, counts, bloom = shard, np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if kind == 0:
                    n = len(blob) // 16
                    keys, counts = np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)
                elif kind == 1:
                    bloom = LogBloom(np.frombuffer(blob, np.uint8), 1, len(blob), hashes, Levels(factor))
                else:
                    out.append((unit, shard, answer(blob, keys, counts, bloom)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=names)

    none = F.lit(None).cast("long")
    both = filled.select("shard", F.lit(0).alias("kind"), none.alias("unit"), F.col("vocab").alias("blob"))
    both = both.union(filled.select("shard", F.lit(1), none, "block")).union(first.mapInArrow(ask, schema).select("shard", F.lit(2), "unit", "blob"))
    told = dealt(both, shards).sortWithinPartitions("shard", "kind").mapInArrow(meet, schema)
    told = scratch.save(told, "told")

    def finish(batches):
        """Of each unit its documents and the answers of the shards, in order."""
        m, now, packed, answers = receive(), None, None, []

        def flush():
            if packed is None:
                return
            rows, unit = opened(packed, m)
            data = [pa.array(unit.sizes, pa.int64()), *map(pa.array, unit.score(answers, m, Levels(factor)))]
            answers.clear()
            yield from pa.Table.from_arrays([*rows.columns[: len(keep)], *data], names=done).to_batches()

        for batch in batches:
            for unit, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if unit != now:
                    yield from flush()
                    now = unit
                if shard is None:
                    packed = blob
                else:
                    answers.append(blob)
        yield from flush()

    found = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    done = [f.name for f in kept + found]
    units = first.count()
    scored = first.union(told).repartition(min(max(1, units), MOST_TASKS), "unit").sortWithinPartitions("unit", F.col("shard").asc_nulls_first())
    scored = scored.mapInArrow(finish, T.StructType(kept + found))
    return scored.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def fold(id_col: str = "doc_id"):
    """Remainder by 5 of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5


def query(docs: DataFrame, **options) -> DataFrame:
    held_out = fold() == 1
    found = score(docs, docs.where(~held_out), **options)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
