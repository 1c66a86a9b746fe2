"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features are hashed counts of words, word shapes and pairs of neighbours of both. A shape replaces runs of letters
and digits by a class and keeps the rest, so that words never seen in training still carry their form. A score is
a sparse dot product: the sum of the weights at the hashed places, over the square root of their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
SIZE = 1 << BITS
#: At most so many labelled documents are used for fitting, chosen by a hash of their id.
MAX_LABELLED = 8000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees: crc32 of the id as text, modulo 5, is 0 (a null id is text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _word(word: bytes) -> tuple[int, int]:
    shape = word
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    return xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape, 7)


def places(words: list[bytes], memo: common.Memo) -> np.ndarray:
    """Hashed places of all n-grams of a text, repeats included."""
    if not words:
        return np.empty(0, np.int64)
    h = np.array(list(map(memo.__getitem__, words)), np.uint64)
    pair = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7))
    every = np.concatenate((h.ravel(), (pair * _MIX).ravel()))
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2. The last place is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from labelled rows outside the held-out fold. Fitting runs in one task over at most ``max_labelled``
    documents; only the weights, of fixed size, come to the driver. Without labels, or without documents, all weights
    are zero. Null labels and null ids are left out; of an id with several labels the lowest counts, of an id with
    several texts the last in order; a null text is empty; other columns are ignored."""
    clean = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = clean.groupBy("doc_id").agg(F.min(label_col).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # one document per id: a repeated id must not lift the bound
    texts = common.pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.Memo(_word)
        for batch in batches:
            memo.trim()
            rows = []
            for text in common.as_bytes(batch.column(1)):
                at, count = np.unique(places(text.split(), memo), return_counts=True)
                x = count / np.sqrt(max(1, count.sum()))
                rows.append(at.astype("<u4").tobytes() + x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for label, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                k = len(raw) // 8
                at = np.append(np.frombuffer(raw, "<u4", k).astype(np.int64), SIZE)
                examples.append((at, np.append(np.frombuffer(raw, "<f4", k, 4 * k).astype(float), 1.0), label))
        model = Ftrl()
        rng = np.random.default_rng(1)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(examples)):
                model.learn(*examples[k])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(np.arange(SIZE + 1)).astype("<f4").tobytes()], pa.binary())], names=["w"])

    encoded = sample.mapInArrow(encode, "doc_id long, label double, x binary")
    rows = encoded.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(train, "w binary").collect()
    return np.frombuffer(rows[0].w, "<f4").astype(float) if rows else np.zeros(SIZE + 1)


def score(docs: DataFrame, weights: np.ndarray, cutoff: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text, one row per input row, without a shuffle. Null text counts as empty; an empty
    text scores the bias alone; a null id counts as held out; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))  # SIZE + 1 floats whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memo = shared.value.astype(float), common.Memo(_word)
        for batch in batches:
            scores = []
            for text in common.as_bytes(batch.column(1)):
                memo.trim()
                at = places(text.split(), memo)
                scores.append(float(w[SIZE] + w[at].sum() / np.sqrt(max(1, len(at)))))
            out = 1 / (1 + np.exp(-np.clip(np.array(scores), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), pa.array((out >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    chosen = common.pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
