"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import lists, slices, utf8
from kairospark.llm.hashing import ALNUM, word_hashes, word_spans
from kairospark.llm.learning import adam, held_out, labelled, sigmoid

BITS = 18
_HEAD = 0x9E3779B97F4A7C15
#: Besides each word its first so many bytes are terms, where it is longer.
HEADS = (6, 7, 8, 9)


@dataclass(frozen=True)
class FactorizationMachine:
    """score = bias + sum of w over a text's distinct terms + the sum of v_i . v_j over all pairs of them."""

    bias: float
    row_of: np.ndarray  # of a hashed term, or -1
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """Probabilities, from (document, hashed term) entries, each given once."""
        row = self.row_of[term]
        doc, row = doc[row >= 0], row[row >= 0]
        total = np.bincount(doc, self.w[row], docs).astype(np.float64)  # whole numbers if there are no entries
        for v in self.v.T:
            total += 0.5 * (np.bincount(doc, v[row], docs) ** 2 - np.bincount(doc, v[row] ** 2, docs))
        return sigmoid(self.bias + total)


def terms(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) once for each pair: lower-case runs of letters and digits, and their heads. wanted: only these hashed terms."""
    data, offsets = utf8(pc.utf8_lower(column.fill_null("")))
    starts, ends, first = word_spans(data, offsets, ALNUM)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for n in (0, *HEADS):
        longer = ends - starts > n
        h = word_hashes(data, starts, ends) if not n else word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n * _HEAD % 2**64)
        term, row = (h >> np.uint64(64 - BITS)).astype(np.int64), rows[longer]
        if wanted is not None:
            keep = wanted[term]
            term, row = term[keep], row[keep]
        found.append((row << BITS) | term)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def paired(rows: list[np.ndarray], y: np.ndarray, terms_: np.ndarray, least: float = 10.0) -> np.ndarray:
    """Which of the sorted terms take part in a pair whose interaction with the label, the mean of (label - share)(x_i - share_i)(x_j - share_j), has a z-score of `least` or more. The bar is high as labels are few and texts have near copies."""
    if not len(terms_) or not len(rows):
        return np.zeros(len(terms_), bool)
    x = np.zeros((len(rows), len(terms_)), np.float32)
    for k, r in enumerate(rows):
        at = np.searchsorted(terms_, r)
        x[k, at[(at < len(terms_)) & (terms_[np.minimum(at, len(terms_) - 1)] == r)]] = 1
    x -= x.mean(0)
    label = (y - y.mean()).astype(np.float32)[:, None]
    spread = np.sqrt((x**2).T @ (x * label) ** 2)
    z = np.abs(np.divide(x.T @ (x * label), spread, out=np.zeros_like(spread), where=spread > 1e-3))
    np.fill_diagonal(z, 0)
    return z.max(1, initial=0) >= least


def fit_machine(rows: list[np.ndarray], y: np.ndarray, *, most_terms: int = 2048, common_terms: int = 512, rank: int = 8, least_docs: int = 3, steps: int = 400, rate: float = 0.03, decay: float = 2e-3, positive: float = 3.0, seed: int = 3) -> FactorizationMachine:
    """Fits by logistic loss, from the hashed terms of each labelled text. Of terms in at least `least_docs` texts, the `most_terms` with the largest z-score of their log-odds take part, which say something alone, and so do those of the `common_terms` that vary most from text to text which say something in a pair, whether or not alone (see paired()). Both are bounds on the sample's terms: with all of them the machine learns the sample by heart (README). A positive row counts `positive` times, as there are few. Without labels nothing is called toxic."""
    row_of = np.full(1 << BITS, -1, np.int64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    bias = np.array([np.log(share / (1 - share))])
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for k in range(0, len(rows), 512):  # whole numbers, so the same sums as of all rows at once
        some = rows[k : k + 512]
        flat, own = np.concatenate(some).astype(np.int64), np.repeat(y[k : k + 512], [len(r) for r in some])
        a += np.bincount(flat, own, 1 << BITS)
        b += np.bincount(flat, minlength=1 << BITS)
    b -= a
    pos, neg = y.sum(), len(y) - y.sum()
    odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos - a + 0.5) + 1 / (neg - b + 0.5))
    z[a + b < least_docs] = 0
    alone = np.argsort(-z, kind="stable")[:most_terms]
    varied = np.where(a + b < least_docs, 0, (a + b) * (len(rows) - a - b))
    common = np.argsort(-varied, kind="stable")[:common_terms]
    common = np.sort(common[varied[common] > 0])
    chosen = np.union1d(alone[z[alone] > 0], common[paired(rows, y, common)])
    row_of[chosen] = np.arange(len(chosen))
    w, v = np.zeros(len(chosen)), np.random.default_rng(seed).normal(0, 0.02, (len(chosen), rank))
    if not len(chosen) or pos == 0 or neg == 0:
        return FactorizationMachine(float(bias[0]), row_of, w, np.zeros_like(v))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, r in enumerate(rows):
        own = row_of[r]
        x[k, own[own >= 0]] = 1

    weight = np.where(y > 0, positive, 1.0) / len(y)

    def gradients(_: int) -> list[np.ndarray]:
        xv = x @ v.astype(np.float32)
        error = ((sigmoid(bias + x @ w.astype(np.float32) + 0.5 * (xv**2 - x @ (v**2).astype(np.float32)).sum(1)) - y) * weight).astype(np.float32)
        each = x.T @ error
        return [np.array([error.sum()]), each + decay * w / len(w), x.T @ (error[:, None] * xv) - v * each[:, None] + decay * v]

    adam([bias, w, v], gradients, steps, rate)
    return FactorizationMachine(float(bias[0]), row_of, w, v)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", sample: int = 8000, most_terms: int = 2048, common_terms: int = 512) -> FactorizationMachine:
    """A machine from at most `sample` labelled documents outside the held-out fifth; only the hashed terms of those reach the driver. most_terms, common_terms: bounds on the terms that take part; see fit_machine(). Null labels and ids are left out; without labels of both kinds, or on an empty table, nothing is called toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            row, term = terms(batch.column("text"))
            yield pa.record_batch([batch.column("id"), batch.column("label"), lists(term.astype(np.int32), np.searchsorted(row, np.arange(batch.num_rows + 1)))], ["id", "label", "terms"])

    own = labelled(docs, labels, target, sample).select("id", F.col("label").cast("int").alias("label"), "text")
    got = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()},  label int, terms array<int>").toArrow().sort_by("id")
    rows, y = [r.values.to_numpy() for r in got["terms"]], got["label"].to_numpy().astype(float)  # rows are views of the table
    machine = fit_machine(rows, y, most_terms=most_terms, common_terms=common_terms)
    del got, rows
    pa.default_memory_pool().release_unused()  # the driver goes on
    return machine


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, *, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (score >= threshold), from the whole text alone.

    Null or empty text: the score of no terms. Null id: kept as null, held out. Repeated rows: one result each. Empty table: no rows. Other columns aren't read. One narrow pass, no shuffle; the model is of fixed size.
    """
    wanted = model.row_of >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score = model.score(*terms(batch.column("text"), wanted), batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: FactorizationMachine, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the threshold, all columns as they are; no shuffle. Null or empty text: the score of no terms. Repeated rows are judged alike. Empty table: no rows."""
    wanted = model.row_of >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield batch.filter(pa.array(model.score(*terms(batch.column("text"), wanted), batch.num_rows) < threshold))

    return docs.mapInArrow(run, docs.schema)
