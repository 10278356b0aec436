"""Labelled samples for the classifiers, and a small Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents whose labels are never learnt from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    """(id, text, label) of at most `sample` labelled documents outside the held-out fifth: those with the smallest hash of their id. Repeated labels of a document count as the largest; null labels are left out."""
    own = labels.where(F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).alias("label"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "label")
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(few), "id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def adam(parameters: list[np.ndarray], gradients: Callable[[int], list[np.ndarray]], steps: int, rate: float) -> None:
    """Changes the parameters in place."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradients(t), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
