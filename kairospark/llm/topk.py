"""Exact top-k search by a vector-approximation file: bounds from quantised cells first, exact vectors in the order of their bounds after."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks with larger whole numbers hold them as doubles, which such numbers are, and are searched with whole numbers of any size.
_MOST = 1 << 53
#: Bytes of a score that no long holds, for its order: the product of two doubles' whole parts, scaled, and the sum of as many as a vector has.
_WIDE = 320
_LONG = (1 << 63) - 1


def packed(batches: Iterator[pa.RecordBatch], most: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `most` vectors of one length: their ids and floor(scale * x), each as bytes; a block with a whole number beyond 2**53 is wide and has the components as they are."""
    held: dict[int, list] = {}
    number = TaskContext.get().partitionId() << 32

    def block(dim: int) -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, vectors = zip(*held.pop(dim), strict=True)
        flat = np.concatenate(vectors)
        with np.errstate(over="ignore"):
            whole = np.floor(scale * flat)
        wide = bool(np.abs(whole).max() > _MOST)
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([wide]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([(flat if wide else whole.astype(np.int64)).tobytes()], pa.binary())], ["dim", "block", "wide", "ids", "vectors"])

    for batch in batches:
        for key, value in zip(batch.column("id").to_pylist(), batch.column("vector"), strict=True):
            if key is None or not value.is_valid or not len(value.values) or value.values.null_count:
                continue
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            held.setdefault(len(x), []).append((key, x))
            if len(held[len(x)]) >= most:
                yield block(len(x))
    for dim in sorted(held):
        yield block(dim)


def approximation(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The VA-file of a block: each component's cell number, and every cell's least and greatest whole number per dimension."""
    low, high = vectors.min(0), vectors.max(0)
    step = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    cells = ((vectors - low) // step).astype(np.uint8)
    edges = low + np.arange(1 << bits)[:, None] * step
    return cells, edges, np.minimum(edges + step - 1, np.maximum(high, edges))


Best = tuple[np.ndarray, np.ndarray]


def wholes(data: np.ndarray, dim: int, wide: bool, scale: float) -> np.ndarray:
    """A block's whole numbers from its bytes: longs, or, of a wide block, whole numbers of any size."""
    if not wide:
        return data.view(np.int64).reshape(-1, dim)
    out = np.empty(data.size, object)
    with np.errstate(over="ignore"):
        for k, (x, y) in enumerate(zip(data.view(np.float64).tolist(), np.floor(scale * data.view(np.float64)).tolist())):
            out[k] = int(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))
    return out.reshape(-1, dim)


def inner(vectors: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products. safe: 64 bits hold them; else they are whole numbers of any size."""
    return vectors @ query if safe else vectors.astype(object) @ query.astype(object)


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> Best:
    """The k largest scores and their ids, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bits: int, held: list[Best] | None = None) -> list[Best]:
    """(vector ids, scores) of each query's k best in this block and among those held from others, best first, ties to the smaller id; a vector with the query's id takes no part. The worst held score bounds what is read here."""
    dim = vectors.shape[1]
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * dim
    longs = queries.dtype == vectors.dtype == np.int64
    bounded, safe = longs and reach < 2**53, longs and reach < 2**63  # sums of doubles below 2**53 are exact, so the bounds are
    held = held or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    if bounded:
        cells, least, greatest = approximation(vectors, bits)
        dims = np.arange(dim)
        low, high = least[cells, dims].astype(np.float64), greatest[cells, dims].astype(np.float64)
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        upper, lower = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    out = []
    for q, key in enumerate(query_ids):
        other = ids != key
        got_ids, got = held[q]
        kth = float(min(max(got[-1], -(2**60)), 2**60)) if len(got) == k else -np.inf  # bounds are under 2**53
        if bounded:
            bound = lower[q][other]
            floor = max(kth, np.partition(bound, len(bound) - k)[len(bound) - k] if len(bound) > k else -np.inf)
            near = np.flatnonzero(other & (upper[q] >= floor))
            near = near[np.argsort(-upper[q][near], kind="stable")]
        else:  # no safe bounds: every vector is read
            near = np.flatnonzero(other)
        at = 0
        while at < len(near) and (not bounded or upper[q][near[at]] >= kth):
            part = near[at : at + 4 * k]
            got_ids, got = best_first(np.append(got_ids, ids[part]), np.append(got, inner(vectors[part], queries[q], safe)), k)
            at += len(part)
            kth = float(min(max(got[-1], -(2**60)), 2**60)) if len(got) == k else -np.inf
        out.append((got_ids, got))
    return out


def places(vector_blocks: int, query_blocks: int, blocks_met: int = 32, most_held: int = 256) -> tuple[int, int]:
    """Over how many rows of a grid vector blocks are dealt, and over how many columns query blocks."""
    return max(1, min(vector_blocks, 48), -(-vector_blocks // blocks_met)), max(1, -(-query_blocks // most_held))


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, bits: int = 4, block: int = 4096, query_block: int = 1024, blocks_met: int = 32, most_held: int = 256) -> DataFrame:
    """Each query's k highest inner products over all vectors, of components floor(scale * x): query_id, rank (from 1), vec_id, score. Ties to the smaller id; all vectors, if fewer than k. Exact.

    Queries meet the vectors in blocks: `query_block` queries with `block` vectors at a time, so no task holds more than two blocks. Vector blocks and query blocks are dealt over a grid: a place has about `blocks_met` vector blocks (fewer where there are few, for 48 places) and `most_held` query blocks, so places grow in number with both tables and none grows with them. A place keeps the best of its query blocks over all vector blocks that it meets, so what one block has found bounds what is read of the next, and gives k rows a query. Blocks are broadcast only if Spark finds them under its own limit.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor does a null id. Vectors of another length than the query's aren't compared. A vector with the query's own id is no candidate. Components are whole numbers of any size and ranks go by true scores; a score that no long holds is shown as the greatest or least long (its negative). Repeated ids: all rows are candidates; of repeated query ids the smallest vector that can take part asks. Empty tables: no rows. Other columns aren't read.
    """

    def own(df: DataFrame) -> DataFrame:
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("vector"))

    schema = "dim int, block long, wide boolean, ids binary, vectors binary"
    blocks = own(vectors).mapInArrow(lambda b: packed(b, block, scale), schema)
    usable = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is the largest
    asked = own(queries).where(usable).groupBy("id").agg(F.min("vector").alias("vector"))
    n = max(1, -(-asked.count() // query_block))
    asking = asked.repartition(n, "id").mapInArrow(lambda b: packed(b, query_block, scale), schema)
    rows, columns = places(-(-vectors.count() // block), n, blocks_met, most_held)
    sent = asking.select("dim", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int").alias("column"), F.col("block").alias("query_block"), F.col("wide").alias("query_wide"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    dealt = blocks.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(rows)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    met = dealt.join(sent, ["dim", "row", "column"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, list[Best]]] = {}

        def found(keys: np.ndarray, best: list[Best]) -> pa.RecordBatch:
            scores = [x for _, s in best for x in s.tolist()]
            side = [0 if -_LONG <= x <= _LONG else 1 if x > 0 else -1 for x in scores]
            order = [(x + (1 << (8 * _WIDE - 2))).to_bytes(_WIDE) if w else None for x, w in zip(scores, side)]
            query = np.repeat(keys, [len(i) for i, _ in best])
            shown = pa.array([min(max(x, -_LONG), _LONG) for x in scores], pa.int64())
            return pa.record_batch([pa.array(query, pa.int64()), pa.array(np.concatenate([i for i, _ in best]), pa.int64()), shown, pa.array(side, pa.int32()), pa.array(order, pa.binary())], ["query_id", "vec_id", "score", "side", "wide"])

        for batch in batches:
            for row in range(batch.num_rows):
                dim, name = batch.column("dim")[row].as_py(), batch.column("query_block")[row].as_py()
                part = {c: np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("ids", "vectors", "query_ids", "queries")}
                own_vectors, own_queries = (wholes(part[c], dim, batch.column(w)[row].as_py(), scale) for c, w in (("vectors", "wide"), ("queries", "query_wide")))
                before = held.pop(name, None)
                if before is None and len(held) >= most_held:
                    yield found(*held.pop(next(iter(held))))  # the one met longest ago
                held[name] = (part["query_ids"].copy(), search(own_queries, part["query_ids"], own_vectors, part["ids"], k, bits, before and before[1]))
        for own in held.values():
            yield found(*own)

    best = met.mapInArrow(run, "query_id long, vec_id long, score long, side int, wide binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("wide"), F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
