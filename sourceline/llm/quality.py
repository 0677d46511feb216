"""Document quality by histogram gradient-boosted trees over document statistics.

The statistics come from the whole text: how its bytes fall into classes, its words and its lines.
Trees are complete and flat: one array each for the feature, the threshold and the leaf values of all
nodes, so a batch of documents walks every tree at once, one level per numpy step.

Fitting takes at most ``max_rows`` labelled documents, those with the smallest hash of their id, so
the sample is the same in every run. All documents are scored.

Defined cases: a null text is an empty one; an empty text gets the score of its statistics like any
other; rows that repeat an id are scored each by itself; a label that is null or that has no document
is not learned from; without a labelled row every score is 0.5; an empty table gives no rows; other
columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, fold_column, numbered

MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 32, 0.15
THRESHOLD = 0.3
FOLDS = 5

BYTE_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:?", "shout": b"!", "quote": b"'\"()[]{}<>",
    "bar": b"|", "dash": b"-_=~", "symbol": b"*$%&#@^+/\\`", "high": bytes(range(128, 256)), "control": bytes(range(9)) + bytes(range(14, 32)),
}
_CLASS = np.zeros((256, len(BYTE_CLASSES)))
for _at, _members in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_members), _at] = 1
FEATURES = (*BYTE_CLASSES, "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "log_lines",
            "repeated_lines", "line_length", "distinct_bytes", "byte_entropy", "commonest_byte")


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    counts, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 11))
    for row, text in enumerate(texts):
        text = text or b""
        counts[row] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        n = max(1, len(words))
        rest[row, :8] = (np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, max(map(len, words), default=0),
                         len(set(words)) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)))
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    share = counts / total
    rest[:, 8] = (counts > 0).sum(1)
    rest[:, 9] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    rest[:, 10] = share.max(1, initial=0)
    return np.hstack([counts @ _CLASS / total, rest])


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            node, tree = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(self.feature))
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                right = np.take_along_axis(x, self.feature[tree, node], 1) > self.threshold[tree, node]
                node = 2 * node + 1 + right
            total = total + self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        smoothing: float = 5.0) -> Trees:
    """Boost logistic loss on quantile-binned features, all nodes of a level in one histogram."""
    inner, n = 2 ** depth - 1, len(x)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    width = bins + 1
    out_f, out_t, out_l = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(n, base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, size = 2 ** level - 1, 2 ** level
            best = np.full(size, 1e-9)
            g_all, h_all = np.bincount(node - first, grad, size), np.bincount(node - first, hess, size)
            cut = np.full(size, width)
            chosen = np.zeros(size, int)
            for f in range(x.shape[1]):
                at = (node - first) * width + code[:, f]
                g = np.bincount(at, grad, size * width).reshape(size, width).cumsum(1)
                h = np.bincount(at, hess, size * width).reshape(size, width).cumsum(1)
                gain = (g ** 2 / (h + smoothing) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + smoothing)
                        - (g_all ** 2 / (h_all + smoothing))[:, None])[:, :len(edges[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    better = gain[np.arange(size), k] > best
                    best[better], cut[better], chosen[better] = gain[np.arange(size), k][better], k[better], f
            for i in range(size):
                if cut[i] < width:
                    out_f[tree, first + i], out_t[tree, first + i] = chosen[i], edges[chosen[i]][cut[i]]
            own = node - first
            node = 2 * node + 1 + (code[np.arange(n), chosen[own]] > cut[own])
        at = node - inner
        leaf = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + smoothing)
        out_l[tree] = leaf
        total += leaf[at]
    return Trees(out_f, out_t, out_l, base)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return fold_column(doc_id) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Trees:
    """Fit on at most ``max_rows`` labels outside the held-out fold: those with the smallest hash of their id.

    Labels that repeat an id and a value count once, and an id that several documents have stands for the
    one whose text has the smallest hash, so no id weighs more than its labels.
    """
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
              .select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(values), pa.list_(pa.float64()))],
                                             ["doc_id", "quality", "values"])

    # at most max_rows ids with a label: the bound of the broadcast
    texts = (docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("first")))
    rows = (texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "first.text")
            .mapInArrow(run, "doc_id long, quality int, values array<double>").orderBy("doc_id", "quality").toPandas())
    x = np.stack(rows["values"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(statistics(batch.column("text").cast(pa.binary()).to_pylist()))
            fold = [crc_of_id(i) % FOLDS == 0 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fold), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics([None if t is None else t.encode() for t in text])))

    return numbered(docs).where(score("doc.text") >= threshold).select("doc.*")
