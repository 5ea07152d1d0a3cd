"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the text alone. The model is trained on the driver from at most MAX_ROWS labelled rows
(those of smallest hash of their id), each statistic binned at quantiles; trees grow by depth with second-order gains
from gradient histograms. A trained model is five arrays, and a batch of rows walks all trees level by level in
numpy. Rows whose crc32(doc_id as text) mod 4 is 2 are held out of training.

Defined cases: null and empty texts have statistics of 0 and get a score; a document with several label rows is
trained on once for each, one with a null label not at all; without any usable label every score is 0.5 (one class:
that class's share); repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters.
MAX_ROWS, BINS, TREES, DEPTH, RATE, LEAST, SMOOTH, LIMIT = 20_000, 32, 80, 4, 0.15, 5, 1.0, 0.7

STATISTICS = [
    "log_words", "log_chars", "word_length", "word_length_spread", "distinct_words", "top_word", "repeat_pairs", "repeat_triples",
    "lower", "upper", "digits", "blanks", "marks", "symbols", "others", "symbol_words", "capital_words", "line_words",
    "distinct_lines", "short_words", "long_words", "pipes", "at_signs", "letters_entropy", "ends_marked",
]


def statistics(text: str | None, hashes: common.WordHashes) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    h = hashes.of(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    _, many = np.unique(h, return_counts=True)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda a, b: byte[a:b].sum() / size
    lower, upper, digits = share(97, 123), share(65, 91), share(48, 58)
    blanks, others = byte[[9, 10, 11, 12, 13, 32]].sum() / size, share(128, 256)
    marks = byte[list(b".,;:?'\"()-")].sum() / size
    letters = byte[97:123] + byte[65:91]
    p = letters[letters > 0] / max(1, letters.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def repeats(k: int) -> float:
        if n < k + 1:
            return 0.0
        keys = sum((h[i : n - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i) for i in range(k)), np.zeros(n - k + 1, np.uint64))
        return 1 - len(np.unique(keys)) / len(keys)

    symbol_words = sum(w[-1] in b"#*$%&|<>!=+~^@{}[]\\_" for w in words) / n
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), len(many) / n, many.max() / n, repeats(2), repeats(3),
        lower, upper, digits, blanks, marks, max(0.0, 1 - lower - upper - digits - blanks - marks - others), others, symbol_words,
        sum(w[:1].isupper() for w in words) / n, n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), (lengths <= 3).mean(),
        (lengths >= 12).mean(), byte[124] / n, byte[64] / n, float(-(p * np.log2(p)).sum()), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
    ]


@dataclass
class Model:
    """Trees of equal depth as flat arrays: node i of a tree has its children at 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; every step moves all rows in all trees one level down."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(self.depth if trees else 0):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.leaf[tree, node - inner].sum(axis=1) if trees else np.zeros(len(x))
        return 1 / (1 + np.exp(-(self.start + total)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Boosts logistic loss; splits are at bin edges."""
    inner, leaves = 2**depth - 1, 2**depth
    share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
    model = Model(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))), depth)
    if len(y) < 2 * LEAST or y.min() == y.max():
        return model
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], axis=1)
    flat, raw = binned + np.arange(d) * bins, np.full(n, model.start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * d * bins + flat).reshape(-1)
            g, h, c = (
                np.bincount(slot, np.repeat(v, d), many * d * bins).reshape(many, d, bins).cumsum(axis=2) for v in (grad, hess, np.ones(n))
            )
            tg, th, tc = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + SMOOTH) + (tg - g) ** 2 / (th - h + SMOOTH) - tg**2 / (th + SMOOTH)
            gain[(c < LEAST) | (tc - c < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g, h = (np.bincount(node - inner, v, leaves) for v in (grad, hess))
        leaf = RATE * g / (h + SMOOTH)
        raw = raw + leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Model(np.array(features), np.array(thresholds), np.array(values), model.start, depth)


MEASURED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    hashes = common.WordHashes()

    def make(batch):
        x = np.array([statistics(t, hashes) for t in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "x": common.lists(x)}

    return common.map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, MEASURED)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Model:
    """Trains on labelled rows that aren't held out, at most `most`."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out())
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = measure(docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")).join(sample, "doc_id").select("x", "y").collect()
    x = np.array([r.x for r in rows], float).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T[::-1]) if len(x) else []  # the same model whatever order the rows come in
    return train(x[order], np.array([r.y for r in rows], float)[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    common.ship(docs.sparkSession)
    hashes = common.WordHashes()

    def make(batch):
        x = np.array([statistics(t, hashes) for t in batch.column(2).to_pylist()])
        p = np.clip(model.score(x), 0, 1)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(p), "predicted": pa.array((p >= LIMIT).astype(np.int32))}

    return common.map_rows(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), make, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    common.ship(docs.sparkSession)
    return score(docs, fit(docs, labels))
