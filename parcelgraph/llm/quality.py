"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; the score is the logistic of a sum of one table
entry per feature and one per selected pair of features.  Tables are learned by
cyclic boosting: each round goes through the features in turn and adds a shallow
tree over one feature's bins, fitted to the current gradients; then pairs that
explain most of what is left get trees of two cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.languages import remainder
from parcelgraph.llm.word_arrays import LINE_ENDS, slices, split_words, text_buffers

#: Most labelled rows that the model is fitted on, taken by a hash of the id.
TRAIN_ROWS = 20_000
BINS = 64
PAIR_BINS = 16
PAIRS = 8
ROUNDS, PAIR_ROUNDS = 150, 60
RATE = 0.15
LEAVES = 4
#: Weight of a leaf's prior at 0, in units of the second derivative.
RIDGE = 2.0
#: A score from here on predicts 1.
CUT = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "log_longest_word", "short_words", "upper", "digits", "punctuation", "symbols",
    "pipes", "exclamations", "ends", "commas", "non_ascii", "lines_per_word", "distinct_words", "repeated_lines", "slashes", "controls",
)


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _marks(bytes(range(65, 91))),
    "digits": _marks(b"0123456789"),
    "punctuation": _marks(b".,;:!?'\"()-"),
    "symbols": _marks(b"#$%&*+<=>@[\\]^_`{|}~"),
    "pipes": _marks(b"|"),
    "exclamations": _marks(b"!"),
    "ends": _marks(b".?!"),
    "commas": _marks(b","),
    "non_ascii": _marks(bytes(range(128, 256))),
    "slashes": _marks(b"/"),
    "controls": _marks(bytes(range(9)) + bytes(range(14, 32)) + b"\x7f"),
}


def _distinct_share(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct over all, for each text; 1 where there is nothing."""
    out = np.ones(len(offsets) - 1)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            x = np.sort(hashes[a:b])
            out[i] = (1 + np.count_nonzero(x[1:] != x[:-1])) / (b - a)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text."""
    words = split_words(data, offsets, lower=False)
    lines = split_words(data, offsets, lower=False, gaps=LINE_ENDS)
    part, at = words.data, offsets - offsets[0]
    per_doc = lambda values, edges: np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[edges])
    n_bytes, n_words = np.diff(at).astype(float), np.diff(words.offsets).astype(float)
    some_bytes, some_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    length = (words.ends - words.starts).astype(float)
    mean = per_doc(length, words.offsets) / some_words
    longest = np.zeros(len(n_words))
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(length, words.offsets[:-1][full])
    columns = {
        "log_bytes": np.log1p(n_bytes),
        "log_words": np.log1p(n_words),
        "word_length": mean,
        "word_length_spread": np.sqrt(np.maximum(per_doc(length**2, words.offsets) / some_words - mean**2, 0)),
        "log_longest_word": np.log1p(longest),
        "short_words": per_doc(length <= 3, words.offsets) / some_words,
        "lines_per_word": np.diff(lines.offsets) / some_words,
        "distinct_words": _distinct_share(words.hashes, words.offsets),
        "repeated_lines": 1 - _distinct_share(lines.hashes, lines.offsets),
    } | {name: per_doc(mark[part], at) / some_bytes for name, mark in _CLASSES.items()}
    return np.column_stack([columns[name] for name in FEATURES])


class Model(NamedTuple):
    """Bin edges by feature, a table by feature, and tables by pair of features on coarser bins."""

    edges: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = self.intercept + self.tables[np.arange(len(self.edges)), at].sum(axis=1)
        coarse = at * PAIR_BINS // BINS
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse[:, i], coarse[:, j]]
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most LEAVES leaves over ordered bins: in turn the cut that gains most."""
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + RIDGE)
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        gains = np.full(len(g) + 1, -np.inf)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mid = np.arange(a + 1, b)
            gains[mid] = value(a, mid) + value(mid, b) - value(a, b)
        best = int(gains.argmax())
        if gains[best] <= 1e-9:
            break
        cuts = sorted([*cuts, best])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(sg[b] - sg[a]) / (sh[b] - sh[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either axis of a table of gradients: its gain and its four leaves."""
    corner = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sg, sh = corner(g), corner(h)
    leaves = []
    for s in (sg, sh):
        a = s[1:-1, 1:-1]
        top, left, total = s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        leaves.append(np.stack([a, top - a, left - a, total - top - left + a]))
    gain = (leaves[0] ** 2 / (leaves[1] + RIDGE)).sum(axis=0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = -leaves[0][:, i, j] / (leaves[1][:, i, j] + RIDGE)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - sg[-1, -1] ** 2 / (sh[-1, -1] + RIDGE)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the model; without rows every score is 0.5."""
    n_features = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(n_features)]
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = Model(edges, float(np.log(base / (1 - base))), np.zeros((n_features, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if not len(x):
        return model
    at = model.bins(x)
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(n_features):
            p = _logistic(total)
            update = RATE * _step(np.bincount(at[:, j], p - y, BINS), np.bincount(at[:, j], p * (1 - p), BINS))
            model.tables[j] += update
            total += update[at[:, j]]
    coarse = at * PAIR_BINS // BINS

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = _logistic(total), coarse[:, i] * PAIR_BINS + coarse[:, j]
        return tuple(np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (p - y, p * (1 - p)))

    gains = {(i, j): _quadrants(*histogram(i, j))[0] for i in range(n_features) for j in range(i)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            update = RATE * _quadrants(*histogram(i, j))[1]
            tables[k] += update
            total += update[coarse[:, i], coarse[:, j]]
    return model._replace(pairs=pairs, pair_tables=tables)


def _features_of(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in slices(offsets):
            yield batch.column(keep).slice(a, b - a), features(data, offsets[a : b + 1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows outside the held-out fold, TRAIN_ROWS of them at most."""
    wanted = labels.filter("quality IS NOT NULL").filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = wanted.count()
    if n > TRAIN_ROWS:
        wanted = wanted.filter(F.shiftrightunsigned(F.xxhash64(F.lit("train"), "doc_id"), 11) < int(TRAIN_ROWS / n * (1 << 53)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, x in _features_of(batches, "quality"):
            yield pa.RecordBatch.from_arrays([label, pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # about TRAIN_ROWS rows of 12 bytes
    rows = sample.select("quality", "text").mapInArrow(run, "quality int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, rows["quality"].to_numpy(int)))  # the order in which tasks end must not matter
    return fit(x[order], rows["quality"].to_numpy(float)[order])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``.

    Null and empty texts are scored like any other, by the features of an empty
    text.  A null doc_id is not held out.  Of a document that is labelled twice
    each distinct label counts.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _features_of(batches, "doc_id"):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(x))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
