"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Outputs are classes: the end of a text, each of the most frequent words, and ``RARE`` classes by the
last three bytes of all other words, inside which a word has its add-one share. A token's class is
predicted from the two classes before it: ``score(c | x, y) = A[x].Q[c] + B[y].Q[c] + bias[c]``. Since
the two contexts enter as factors, the normaliser of every context pair is one matrix product,
``log(exp(A Q') exp(B Q' + bias)')``, and a token's log-probability is three look-ups.

Everything is learned from all training documents: word counts by a shuffle, parameters by one pass
in ``ROUNDS`` parts. In a round each task starts from the same parameters, trains on its documents
with noise shared by a minibatch, and the results are averaged by tokens, in two levels, so that the
driver sees one set of parameters. Words beyond the ``HEAD`` most frequent ones, which all tasks know,
meet their counts in a join.

Defined cases: a null or empty text is an end alone; a word never seen in training has count 0; with no
training document the classes are equally likely; rows that repeat an id are scored each by itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import stored
from .common import fold_column

FOLDS, HELD_OUT = 7, 2
WORDS, RARE, HEAD = 2048, 510, 100_000
CLASSES = 1 + WORDS + RARE + 1
START = CLASSES - 1
SIZE, NOISE, MINIBATCH, RATE, G0, ROUNDS = 16, 128, 2048, 0.1, 10.0, 2
FLUSH, HELD = 300_000, 1 << 18
CHUNKS, FAN = 16, 64
_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def rare_class(word: bytes) -> int:
    return 1 + WORDS + zlib.crc32(word[-3:]) % RARE


def word_counts(train: DataFrame) -> DataFrame:
    """``word binary, n`` over all tokens; the end is the empty word."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                if text.is_valid:
                    held.update(text.as_py().lower().split())
                held[b""] += 1
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()
    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    head: list[bytes]
    n: np.ndarray
    end: int
    tokens: int
    types: int
    rare_total: np.ndarray
    class_n: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        """At most ``HEAD`` words, one total per class and one count per step of frequency reach the driver.

        The head is all words above a frequency, the lowest of steps of 1/64 octave that leaves at most ``HEAD``.
        """
        totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n")))).first()
        step, known = F.floor(F.log2("n") * 64).cast("int"), counts.where(F.length("word") > 0)
        lowest, room = None, HEAD
        for at, words in sorted(map(tuple, known.groupBy(step.alias("step")).count().collect()), reverse=True):
            if words > room:
                break
            lowest, room = at, room - words
        top = sorted(known.where(step >= lowest).collect(), key=lambda r: (-r["n"], bytes(r["word"]))) if lowest is not None else []
        head, n = [bytes(r[0]) for r in top], np.array([r[1] for r in top], dtype=np.int64)
        by_class = (counts.where(F.length("word") > 0)
                    .groupBy((F.crc32(F.substring("word", -3, 3)) % RARE).cast("int").alias("c")).agg(F.sum("n"), F.count("*")).collect())
        rare, types = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for c, m, k in by_class:
            rare[c], types[c] = m, k
        for word, m in zip(head[:WORDS], n[:WORDS], strict=True):
            c = rare_class(word) - 1 - WORDS
            rare[c], types[c] = rare[c] - m, types[c] - 1
        class_n = np.zeros(CLASSES, np.int64)
        class_n[0], class_n[1:1 + len(n[:WORDS])], class_n[1 + WORDS:START] = totals[2] or 0, n[:WORDS], rare
        return cls(head, n, totals[2] or 0, totals[0] or 0, totals[1], rare + types + 1, class_n)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``row_id, doc_id, held_out, n_tokens, n_known, known_log, inside_log, classes, rare`` as a written table.

    ``known_log`` sums ``log10(c + 1)`` of head words and the end, ``inside_log`` the log10 shares inside
    rare classes as far as known without the counts of ``rare``, the words beyond the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        index = _Index(zip(v.head, range(len(v.head)), strict=True))
        classes = np.array([1 + i if i < WORDS else rare_class(w) for i, w in enumerate(v.head)] + [0], np.int16)
        log_n = np.append(np.log10(v.n + 1.0), 0.0)
        log_total = np.log10(v.rare_total)
        inside = np.append(np.where(np.arange(len(v.n)) < WORDS, 0.0, log_n[:-1] - log_total[np.maximum(classes[:-1] - 1 - WORDS, 0) % RARE]), 0.0)
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "known_log", "inside_log", "classes")}
            words, times, offsets = [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                tokens = text.as_py().lower().split() if text.is_valid else []
                at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                ids = classes[at]
                unknown = np.flatnonzero(at < 0).tolist()
                if unknown:
                    far = [tokens[i] for i in unknown]
                    own = np.array([rare_class(w) for w in far], np.int16)
                    ids[unknown] = own
                    tally = Counter(far)
                    words += tally.keys()
                    times += tally.values()
                    minus = log_total[own - 1 - WORDS].sum()
                else:
                    minus = 0.0
                offsets.append(len(words))
                columns["n_tokens"].append(len(tokens) + 1)
                columns["n_known"].append(len(tokens) - len(unknown) + (v.end > 0))
                columns["known_log"].append(float(log_n[at].sum() + np.log10(v.end + 1.0)))
                columns["inside_log"].append(float(inside[at].sum() - minus))
                columns["classes"].append(np.append(ids, np.int16(0)).astype("<i2").tobytes())
            kind = pa.struct([("word", pa.binary()), ("times", pa.int32())])
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(words, pa.binary()), pa.array(times, pa.int32())], fields=list(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), batch.column("held_out"), pa.array(columns["n_tokens"], pa.int64()),
                 pa.array(columns["n_known"], pa.int64()), pa.array(columns["known_log"]), pa.array(columns["inside_log"]),
                 pa.array(columns["classes"], pa.binary()), rare],
                ["row_id", "doc_id", "held_out", *columns, "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       (fold_column(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "text")
    return stored(rows.mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, inside_log double, "
                                       "classes binary, rare array<struct<word: binary, times: int>>"), "lm-encoded")


@dataclass(frozen=True)
class Model:
    """``flat`` holds A, B and Q, ``CLASSES`` x ``SIZE`` each, then the biases."""

    flat: np.ndarray
    key: str

    @classmethod
    def start(cls, class_n: np.ndarray, seed: int = 1) -> Model:
        flat = np.random.default_rng(seed).normal(0, 0.1, 3 * CLASSES * SIZE + CLASSES).astype(np.float32)
        flat[-CLASSES:] = np.log(noise_shares(class_n))
        return cls(flat, uuid.uuid4().hex)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = CLASSES * SIZE
        a, b, q = (self.flat[i * n:(i + 1) * n].reshape(CLASSES, SIZE) for i in range(3))
        return a, b, q, self.flat[3 * n:]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every class after either context, and the log-normaliser of every pair of contexts."""
        if self.key not in _TABLES:
            _TABLES.clear()
            a, b, q, bias = self.parts()
            first, second = a @ q.T, b @ q.T + bias
            second[:, START] = -1e4
            top1, top2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
            further = np.exp(second - top2).T
            norm = np.empty_like(first)
            for at in range(0, CLASSES, 256):
                norm[at:at + 256] = np.log(np.exp(first[at:at + 256] - top1[at:at + 256]) @ further) + top1[at:at + 256] + top2.T
            _TABLES[self.key] = first, second, norm
        return _TABLES[self.key]


def noise_shares(class_n: np.ndarray) -> np.ndarray:
    shares = class_n + 1.0
    return shares / shares.sum()


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; ``first`` marks where texts begin."""
    one = np.concatenate([[START], ids[:-1]])
    one[first] = START
    two = np.concatenate([[START], one[:-1]])
    two[first] = START
    return one, two


def _rows(index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by class."""
    return np.stack([np.bincount(index, column, CLASSES) for column in values.T], 1).astype(np.float32)


def train_on(model: Model, texts: Iterable[np.ndarray], class_n: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """One pass of noise-contrastive estimation from ``model``; new parameters and the tokens seen."""
    rng = np.random.default_rng(seed)
    flat = model.flat.copy()
    a, b, q, bias = Model(flat, "").parts()
    square = [np.full(p.shape, G0, np.float32) for p in (a, b, q, bias)]
    shares = noise_shares(class_n)
    cumulative, offset, seen = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32), 0

    def step(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), CLASSES - 1)
        h = a[x] + b[y]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, q[w]) + bias[w] - offset[w]))
        down = 1 / (1 + np.exp(offset[noise] - bias[noise] - h @ q[noise].T))
        g_h = up[:, None] * q[w] - down @ q[noise]
        g_q = _rows(w, up[:, None] * h)
        np.subtract.at(g_q, noise, down.T @ h)
        g_bias = np.bincount(w, up, CLASSES)
        np.subtract.at(g_bias, noise, down.sum(0))
        for p, s, g in zip((a, b, q, bias), square, (_rows(x, g_h), _rows(y, g_h), g_q, g_bias.astype(np.float32)), strict=True):
            s += g * g
            p += RATE * g / np.sqrt(s)

    def learn(held: list[np.ndarray]) -> int:
        ids = np.concatenate(held).astype(np.int64)
        first = np.cumsum([0, *map(len, held[:-1])])
        one, two = contexts(ids, first)
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), MINIBATCH):
            some = order[at:at + MINIBATCH]
            step(ids[some], one[some], two[some])
        return len(ids)

    held, size = [], 0
    for ids in texts:
        held.append(ids)
        size += len(ids)
        if size >= HELD:
            seen += learn(held)
            held, size = [], 0
    if held:
        seen += learn(held)
    return flat, seen


def _mean(frame: pd.DataFrame) -> tuple[int, bytes]:
    weight = frame["weight"].to_numpy(np.int64)
    values = np.stack([np.frombuffer(v, np.float32) for v in frame["values"]]).astype(np.float64)
    return int(weight.sum()), (weight @ values / max(1, weight.sum())).astype(np.float32).tobytes()


def train(coded: DataFrame, class_n: np.ndarray) -> Model:
    """All training documents once, in ``ROUNDS`` parts."""
    model = Model.start(class_n)
    sc = coded.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = sc.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pd.DataFrame]:
            part = TaskContext.get().partitionId()
            texts = (np.frombuffer(x, "<i2") for batch in batches for x in batch["classes"])
            flat, seen = train_on(shared.value, texts, class_n, turn * 1_000_003 + part)
            if seen:
                for chunk, values in enumerate(np.array_split(flat, CHUNKS)):
                    yield pd.DataFrame({"chunk": [chunk], "fan": [part % FAN], "weight": [seen], "values": [values.tobytes()]})

        def near(frame: pd.DataFrame) -> pd.DataFrame:
            weight, values = _mean(frame)
            return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "fan": [0], "weight": [weight], "values": [values]})

        kind = "chunk int, fan int, weight long, values binary"
        rows = (coded.where(~F.col("held_out") & (F.pmod(F.xxhash64("row_id"), F.lit(ROUNDS)) == turn)).select("classes")
                .mapInPandas(run, kind).groupBy("chunk", "fan").applyInPandas(near, kind)
                .groupBy("chunk").applyInPandas(near, kind).collect())
        if rows:
            model = Model(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])]), uuid.uuid4().hex)
    return model


def token_log_probabilities(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token's class."""
    one, two = contexts(ids, first)
    before, further, norm = model.tables()
    return before[one, ids].astype(np.float64) + further[two, ids] - norm[one, two]


def text_scores(coded: DataFrame, model: Model) -> DataFrame:
    """``row_id, class_log``: log10 probability of each text's classes."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, "<i2") for x in batch.column("classes").to_pylist()]
            total = []
            for at in range(0, len(texts), 128):
                some = texts[at:at + 128]
                first = np.cumsum([0, *map(len, some[:-1])])
                values = token_log_probabilities(shared.value, np.concatenate(some).astype(np.int64), first)
                total.append(np.add.reduceat(values, first) / np.log(10))
            if total:
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.concatenate(total))], ["row_id", "class_log"])

    return coded.select("row_id", "classes").mapInArrow(run, "row_id long, class_log double")


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each row of ``docs``."""
    train_docs = docs.where(fold_column(F.col("doc_id")) % FOLDS != HELD_OUT)
    counts = stored(word_counts(train_docs), "lm-counts")
    vocabulary = Vocabulary.of(counts)
    coded = encoded(docs, vocabulary)
    model = train(coded, vocabulary.class_n)
    far = coded.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.word", "x.times")
    far = (far.join(counts, "word").groupBy("row_id")
           .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("far_log"), F.sum("times").alias("far_known")))
    space = float(np.log10(vocabulary.tokens + vocabulary.types + 1.0))
    far_log = F.coalesce("far_log", F.lit(0.0))
    return (coded.select("row_id", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "inside_log")
            .join(text_scores(coded, model), "row_id").join(far, "row_id", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
                    F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
                    (F.col("known_log") + far_log - F.col("n_tokens") * space).alias("base_score"),
                    (F.col("class_log") + F.col("inside_log") + far_log).alias("score")))
