"""Language identification by a bidirectional gated recurrent network over bytes.

The network is a gated recurrent unit in each direction (reset gate, update gate, candidate; hard
sigmoid and hard tanh), followed by a softmax that labels every position. It is trained here, in
numpy, by backpropagation through time. A text is cut into spans of equal length, which cover it
whole; the probabilities of all of its letter positions are averaged into the document's.

The training sample is bounded: at most ``sample_rows`` labelled documents, spread evenly over the
labels, each with its whole text. Labels, sources and ids are no inputs.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there
is nothing to learn from (``recognised`` then keeps all texts with a letter); a null label is not
learned from; a null id counts as empty text when folds are dealt; repeated rows get equal
predictions; of labels with equal probabilities (ties) the first in order is predicted; texts of
any length are read whole, in batches of bounded bytes; an empty table gives no rows; a kept column
with the name, in any case, of a new one gives way to it, and ``recognised`` keeps all columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as pickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

UNKNOWN = "und"
SPAN = 64
_ROWS = 1024  # spans computed at a time
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: What the network sees: letters in lower case, and one byte for all the rest.
_FOLD = np.where(_LETTER[_UPPER], _UPPER, 32).astype(np.uint8)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, (number of spans, SPAN), padded with blanks; and the text of each span."""
    counts = np.array([-(-len(t) // SPAN) for t in texts], np.int64)
    padded = b"".join(t + b" " * (-len(t) % SPAN) for t in texts)
    cells = _FOLD[np.frombuffer(padded, np.uint8)].reshape(-1, SPAN)
    return cells, np.repeat(np.arange(len(texts)), counts)


class Network:
    """Both directions side by side: axis 0 of every array is the direction."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.labels, self.hidden = labels, hidden
        self.p = {
            "embed": (rng.standard_normal((2, 3 * hidden, 256)) * 0.5).astype(f),
            "gates": (rng.standard_normal((2, 2 * hidden, hidden)) * 0.3).astype(f),
            "cand": (rng.standard_normal((2, hidden, hidden)) * 0.3).astype(f),
            "out": (rng.standard_normal((2, len(labels), hidden)) * 0.3).astype(f),
            "bias": np.zeros((len(labels), 1), f),
        }

    def states(self, cells: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(direction, hidden, position, row)."""
        n, size, h = len(cells), cells.shape[1], self.hidden
        steps = np.stack([cells.T, cells.T[::-1]]).astype(np.intp)  # (direction, step, row)
        embed, gates, cand = self.p["embed"], self.p["gates"], self.p["cand"]
        state = np.zeros((2, h, n), np.float32)
        out = np.empty((2, h, size, n), np.float32)
        x = np.empty((2, 3 * h, n), np.float32)
        for t in range(size):
            for d in (0, 1):
                np.take(embed[d], steps[d, t], axis=1, out=x[d], mode="clip")
            g = gates @ state
            g += x[:, : 2 * h]
            g *= 0.2
            g += 0.5
            np.clip(g, 0, 1, out=g)
            c = cand @ (g[:, :h] * state)
            c += x[:, 2 * h :]
            np.clip(c, -1, 1, out=c)
            if trace is not None:
                trace.append((steps[:, t], state.copy(), g.copy(), c.copy()))
            c -= state
            c *= g[:, h:]
            state += c
            out[0, :, t] = state[0]
            out[1, :, size - 1 - t] = state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(label, position, row)."""
        _, h, size, n = states.shape
        flat = states.reshape(2, h, size * n)
        y = self.p["out"][0] @ flat[0]
        y += self.p["out"][1] @ flat[1]
        y += self.p["bias"]
        y -= y.max(axis=0)
        np.exp(y, out=y)
        y /= y.sum(axis=0)
        return y.reshape(-1, size, n)

    def train(self, cells: np.ndarray, truth: np.ndarray, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(cells), batch)
            slopes = self.slopes(cells[at], truth[at])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, s in slopes.items():
                np.clip(s, -1, 1, out=s)
                first[k] += 0.1 * (s - first[k])
                second[k] += 0.01 * (s * s - second[k])
                self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)

    def slopes(self, cells: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy of the letter positions."""
        n, size, h = len(cells), cells.shape[1], self.hidden
        trace: list = []
        states = self.states(cells, trace)
        err = self.probabilities(states)
        err[truth, :, np.arange(n)] -= 1
        weight = _LETTER[cells.T].astype(np.float32)
        err *= weight / max(1.0, float(weight.sum()))
        flat, err_flat = states.reshape(2, h, -1), err.reshape(len(self.labels), -1)
        got = {k: np.zeros_like(v) for k, v in self.p.items()}
        got["bias"] = err_flat.sum(axis=1, keepdims=True)
        for d in (0, 1):
            got["out"][d] = err_flat @ flat[d].T
        back = np.stack([self.p["out"][d].T @ err_flat for d in (0, 1)]).reshape(2, h, size, n)
        down = np.zeros((2, h, n), np.float32)
        inputs = np.empty((2, 3 * h, size, n), np.float32)
        gates_t, cand_t = self.p["gates"].transpose(0, 2, 1), self.p["cand"].transpose(0, 2, 1)
        for t in range(size - 1, -1, -1):
            _, before, g, c = trace[t]
            down += np.stack([back[0, :, t], back[1, :, size - 1 - t]])
            r, z = g[:, :h], g[:, h:]
            dc = down * z * (np.abs(c) < 1)
            drh = cand_t @ dc
            dg = np.concatenate([drh * before, down * (c - before)], axis=1)
            dg *= 0.2 * ((g > 0) & (g < 1))
            got["cand"] += dc @ (r * before).transpose(0, 2, 1)
            got["gates"] += dg @ before.transpose(0, 2, 1)
            inputs[:, : 2 * h, t], inputs[:, 2 * h :, t] = dg, dc
            down = down * (1 - z) + drh * r + gates_t @ dg
        for d, order in enumerate((cells.T, cells.T[::-1])):
            seen = np.zeros((size * n, 256), np.float32)
            seen[np.arange(size * n), order.ravel()] = 1
            got["embed"][d] = inputs[d].reshape(3 * h, -1) @ seen
        return got

    def positions(self, text: bytes) -> list[str]:
        """The label of every byte of a text."""
        cells, _ = spans([text])
        best = self.probabilities(self.states(cells)).argmax(axis=0).T.ravel()[: len(text)]
        return [self.labels[k] for k in best]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, label): mean probabilities of the letter positions."""
        cells, owner = spans(texts)
        total = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts))
        for i in range(0, len(cells), _ROWS):
            part = cells[i : i + _ROWS]
            letters = _LETTER[part.T]
            p = self.probabilities(self.states(part))
            p *= letters
            np.add.at(total, owner[i : i + _ROWS], p.sum(axis=1, dtype=np.float32).T)
            np.add.at(count, owner[i : i + _ROWS], letters.sum(axis=0))
        return total / np.maximum(count, 1)[:, None]


def sample(docs: DataFrame, sample_rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most sample_rows labelled documents, those with the least hashes of each label. Only a
    share of a label's rows, by hash, takes part, so that about twice the sample is ranked at most."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    mark = F.xxhash64(F.col(f"`{id_col}`"), F.lit("language sample"))
    slim = docs.select(lang.alias("lang"), mark.alias("mark")).where("lang is not null")
    # A sample holds no more labels than rows, so the table of shares is as small as that.
    share = slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows)
    share = share.select("lang", (F.lit(2.0 * sample_rows) / F.col("count")).alias("share"))
    slim = slim.join(F.broadcast(share), "lang").where(F.pmod("mark", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    ranked = slim.withColumn("rank", rank).where(F.col("rank") <= sample_rows)
    chosen = ranked.orderBy("rank", "mark").limit(sample_rows).select("lang", "mark").distinct()
    part = docs.select(lang.alias("lang"), mark.alias("mark"), text.alias("text"))
    rows = part.join(F.broadcast(chosen), ["lang", "mark"]).where("text is not null")
    return rows.orderBy("mark", "text").limit(sample_rows).select("lang", "text")


def train(
    docs: DataFrame,
    sample_rows: int = 1200,
    steps: int = 260,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Network | None:
    """docs: the labelled documents to learn from. None if there are none. The training is one
    task over the bounded sample, so that a lost executor only repeats it."""

    def learn(batches):
        rows = [(r["lang"], r["text"].encode()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, steps))], pa.binary())], names=["net"])

    rows = sample(docs, sample_rows, id_col, text_col, lang_col)
    made = rows.coalesce(1).mapInArrow(learn, "net binary").head()
    return pickle.loads(made.net) if made else None  # no partition, no task


def fit(rows: list[tuple[str, bytes]], steps: int) -> Network | None:
    rows = [(lang, t) for lang, t in rows if has_letter(t)]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    cells, owner = spans([t for _, t in rows])
    truth = np.array([labels.index(lang) for lang, _ in rows])[owner]
    # Labels weigh alike, whatever their share of the sample.
    per = max(np.bincount(truth))
    even = np.concatenate([np.resize(np.flatnonzero(truth == k), per) for k in range(len(labels))])
    net = Network(labels)
    net.train(cells[even], truth[even], steps if len(labels) > 1 else 0)
    return net


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", keep=None) -> DataFrame:
    """docs with lang_pred and score, the mean probability of the predicted label."""

    def make():
        def run(texts):
            known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                p = net.pooled([texts[i] for i in known])
                for i, row in zip(known, p):
                    k = int(row.argmax())
                    pred[i], score[i] = net.labels[k], min(1.0, float(row[k]))
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text_col, fields, make, keep)


def fold(id_col: str = "doc_id"):
    """Remainder by 5 of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5


def identify(docs: DataFrame, keep=None, **options) -> DataFrame:
    """Learn from the labelled documents of folds 1 to 4, predict all."""
    return predict(docs, train(docs.where(fold() != 0), **options), keep=keep)


def recognised(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is recognised: not ``und``, with a score of ``least`` or
    more; with their own columns. Where no document is labelled, no language can be told from
    another, and only the texts without a letter go."""
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    net = train(docs.where(fold() != 0))
    if net is None:
        make = lambda: lambda texts: [pa.array([has_letter(t) for t in texts], pa.bool_())]
        found = map_texts(named, text, [T.StructField("lettered", T.BooleanType())], make).where("lettered")
    else:
        found = predict(named, net, text_col=text)
        found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, keep=["doc_id"])
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
