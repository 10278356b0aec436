"""Quality by random-indexing word vectors pooled per document and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import lists, slices, utf8
from kairospark.llm.hashing import ALNUM, SPACES, mix, word_hashes, word_spans
from kairospark.llm.learning import adam, held_out, labelled, sigmoid

BITS, WIDTH, BLOCK = 14, 64, 256
#: Neighbours that count, and the nonzero places of each index vector.
REACH, PLACES = 2, 2
MARKS = ~ALNUM & ~SPACES
_CHUNK = 1 << 16


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, runs of letters and digits and runs of other marks in their order, and where each row starts. Case counts."""
    data, offsets = utf8(column)
    words, marks = word_spans(data, offsets, ALNUM), word_spans(data, offsets, MARKS)
    start, end = np.concatenate([words[0], marks[0]]), np.concatenate([words[1], marks[1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return (word_hashes(data, start, end) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(start, offsets)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector, from its number alone."""
    h = mix(np.arange(1 << BITS, dtype=np.uint64)[:, None] * np.uint64(PLACES) + np.arange(PLACES, dtype=np.uint64) + np.uint64(1))
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def contexts(docs: DataFrame, salts: int | None = None) -> np.ndarray:
    """For each of the 2**BITS buckets the sum of its neighbours' index vectors, over every text of docs.

    Each partition sums into one matrix of fixed size; its blocks of rows are shuffled and added up as they stream in, first in `salts` groups of partitions (by default as many as the square root of their number, 32 at least, so neither step has a task whose input grows as the table does), then over these. No task holds more than that matrix and the driver receives it once (8 MB).
    """

    own = docs.select("text")
    if salts is None:
        salts = max(32, math.isqrt(own.rdd.getNumPartitions()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors()
        total, tokens, salt = np.zeros((1 << BITS) * WIDTH), 0, TaskContext.get().partitionId() % salts

        def sums() -> pa.RecordBatch:
            rows = total.astype(np.int32).reshape(-1, BLOCK * WIDTH)
            return pa.record_batch([pa.array(np.full(len(rows), salt, np.int32)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["salt", "block", "sums"])

        for batch in slices(batches, "text", 1 << 22):
            bucket, first = token_stream(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(first))
            for away in range(1, REACH + 1):
                left, right = bucket[:-away], bucket[away:]
                same = row[:-away] == row[away:]
                left, right = left[same], right[same]
                if not len(left):
                    continue
                tokens += len(left)
                for word, other in ((left, right), (right, left)):
                    for k in range(PLACES):
                        total += np.bincount(word * WIDTH + place[other, k], sign[other, k], len(total))
            if tokens > 1 << 28:  # a sum is under 2 * PLACES times that, so 32 bits hold it
                yield sums()
                total[:], tokens = 0, 0
        if tokens:
            yield sums()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                raw = raw.as_buffer()
                part = np.frombuffer(raw, np.int32 if raw.size == 4 * BLOCK * WIDTH else np.int64).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    blocks = (1 << BITS) // BLOCK
    parts = own.mapInArrow(count, "salt int, block int, sums binary")
    once = parts.repartition(salts, "salt", "block").select("block", "sums").mapInArrow(add, "block int, sums binary")
    out = np.zeros((blocks, BLOCK * WIDTH))
    for block, raw in once.repartition(blocks, "block").mapInArrow(add, "block int, sums binary").collect():
        out[block] += np.frombuffer(raw, np.int64)
    return out.reshape(1 << BITS, WIDTH)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, after the common direction, of the frequent neighbours, is taken out."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    unit -= np.where(length > 0, unit.sum(0) / max(1, (length > 0).sum()), 0)
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, length, out=np.zeros_like(unit), where=length > 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors; zeros for a text without words. Vectors are summed for `_CHUNK` tokens at a time, so a very long text takes no more than that."""
    bucket, first = token_stream(column)
    n, row = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(n), 2 * WIDTH), np.float32)
    for a in range(0, len(bucket), _CHUNK):
        each, own = vectors[bucket[a : a + _CHUNK]], row[a : a + _CHUNK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts], :WIDTH] += np.add.reduceat(each, starts, axis=0)
        out[own[starts], WIDTH:] += np.add.reduceat(each * each, starts, axis=0)
    out /= np.maximum(n, 1)[:, None]
    out[:, WIDTH:] = np.sqrt(np.maximum(out[:, WIDTH:] - out[:, :WIDTH] ** 2, 0))
    return out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return sigmoid((np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0] / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, *, hidden: int = 32, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> QualityModel:
    """Two layers by logistic loss on four fifths of the rows; the temperature that fits the probabilities best on the rest."""
    rng = np.random.default_rng(seed)
    shift, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * WIDTH), np.ones(2 * WIDTH))
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    if not len(x) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return QualityModel(vectors, shift, scale, (*layers[:2], 0 * layers[2], np.array([np.log(share / (1 - share))])), 1.0)
    part = rng.permutation(len(x))
    fit, rest = part[len(x) // 5 :], part[: len(x) // 5]
    z = (x - shift) / scale
    w1, b1, w2, b2 = layers

    def gradients(t: int) -> list[np.ndarray]:
        own = fit[np.random.default_rng(t).integers(len(fit), size=min(1024, len(fit)))]
        h = np.maximum(z[own] @ w1 + b1, 0)
        error = ((sigmoid((h @ w2 + b2)[:, 0]) - y[own]) / len(own))[:, None]
        back = (error @ w2.T) * (h > 0)
        return [z[own].T @ back + decay * w1, back.sum(0), h.T @ error + decay * w2, error.sum(0)]

    adam(layers, gradients, steps, rate)
    logit = (np.maximum(z[rest] @ w1 + b1, 0) @ w2 + b2)[:, 0]
    if not len(rest):
        return QualityModel(vectors, shift, scale, tuple(layers), 1.0)
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [float(np.mean(np.logaddexp(0, logit / t) - y[rest] * logit / t)) for t in grid]
    return QualityModel(vectors, shift, scale, tuple(layers), float(grid[int(np.argmin(loss))]))


def fit_quality(docs: DataFrame, labels: DataFrame, *, target: str = "quality", sample: int = 8000) -> QualityModel:
    """Word vectors from every text of docs, in 2**BITS hashed buckets; the network from at most `sample` labelled documents outside the held-out fifth. Null labels and ids are left out; without labels of both kinds, or on an empty table, all scores are the labels' share, 0.5 without any."""
    vectors = word_vectors(contexts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x = pooled(batch.column("text"), shared.value)
            yield pa.record_batch([batch.column("id"), batch.column("label"), lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], ["id", "label", "x"])

    own = labelled(docs, labels, target, sample).select("id", F.col("label").cast("int").alias("label"), "text")
    got = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()},  label int, x array<float>").toArrow().sort_by("id")
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * WIDTH) if got.num_rows else np.zeros((0, 2 * WIDTH))
    return fit_network(x.astype(np.float64), got["label"].to_numpy().astype(float), vectors)


def quality_scores(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (score >= threshold), from the whole text alone.

    Null or empty text: the score of a text without words. Null id: kept as null, held out. Repeated rows: one result each. Empty table: no rows. Other columns aren't read. One narrow pass; the model is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score = shared.value.score(pooled(batch.column("text"), shared.value.vectors))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
