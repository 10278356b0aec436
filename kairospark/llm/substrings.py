"""Substring deduplication: a count-min prefilter over word windows, then exact groups of the windows that it can't rule out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import stored, utf8
from kairospark.llm.hashing import mix, windows, word_hashes, word_spans

_ROWS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def window_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window of `size` words of one row, the index of the word that it starts at; and where each row's words begin."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + size <= last)
    one, two = (windows(words, size, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in (1, 2))
    return np.stack([one, two]), at, first


# A payload is a sorted set of keys and whether each was met twice or more, as bytes.


def coded(keys: np.ndarray, twice: np.ndarray) -> bytes:
    """Gaps of sorted 64-bit keys by planes of two bytes, as many as the largest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = max(1, -(-int(gaps.max(initial=np.uint64(0))).bit_length() // 16))
    parts = [np.array([len(keys), planes], np.int64).tobytes()]
    parts += [((gaps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for k in range(planes)]
    return b"".join([*parts, np.packbits(twice).tobytes()])


def decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, planes = np.frombuffer(raw, np.int64, 2)
    gaps = np.zeros(n, np.uint64)
    for k in range(planes):
        gaps |= np.frombuffer(raw, np.uint16, n, 16 + 2 * n * k).astype(np.uint64) << np.uint64(16 * k)
    return np.cumsum(gaps, dtype=np.uint64), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 16 + 2 * n * planes), count=n).astype(bool)


def distinct(keys: np.ndarray, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (each a column of one or two words) and whether each occurs twice or more; several: which of the given ones stand for more than one already."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.ones(keys.shape[1] + 1, bool)
    new[1:-1] = (keys[:, 1:] != keys[:, :-1]).any(0)
    twice = ~new[1:][new[:-1]]
    if several is not None and several.any():
        twice |= np.logical_or.reduceat(several[order], np.flatnonzero(new[:-1]))
    return keys[:, new[:-1]], twice


def counted_often(own: DataFrame, most: int) -> tuple[int, bool, DataFrame]:
    """The bytes of all texts, whether any are counted, and the rows of own (id, text) with `n`, how many rows are equal to each in both.

    Rows of which the equal ones have over `most` bytes together are counted with map-side combining and stand there once, so however many they are, no task gets them all; other rows stay as they are, with n = 1. Hashes of such rows, at most bytes / most of them, are written once; Spark broadcasts them only if they are small.
    """
    print_ = F.xxhash64("id", "text")
    per = own.groupBy(print_.alias("print")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    often = (F.col("rows") > 1) & (F.col("bytes") > most)
    size, hot = per.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(often)).first()
    one = F.lit(1).cast("long").alias("n")
    if not hot:
        return size, False, own.select("id", "text", one)
    prints, marked = stored(per.where(often).select("print")), own.withColumn("print", print_)
    rest = marked.join(prints, "print", "left_anti").select("id", "text", one)
    return size, True, rest.unionByName(marked.join(prints, "print", "left_semi").groupBy("id", "text").agg(F.count("*").alias("n")))


def as_often(rows: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Each row n times, without n: dealt in steps, so that a row with a great n is repeated by many tasks."""
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))))
    left = F.least(F.col("n") - F.col("part") * step, F.lit(step))
    return parts.withColumn("left", left).repartition("part", "id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left")))).drop("n", "part", "left", "copy")


def repeated(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For several sorted distinct sets, which keys of each occur twice or more over all."""
    if not parts:
        return []
    keys = np.concatenate([k for k, _ in parts], axis=1)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    ordered = keys[:, order]
    edge = np.ones(len(order) + 1, bool)
    edge[1:-1] = (ordered[:, 1:] != ordered[:, :-1]).any(0)
    group = np.cumsum(edge[:-1]) - 1
    size = np.diff(np.flatnonzero(edge))
    many = size > 1
    many[group[np.concatenate([t for _, t in parts])[order]]] = True
    out = np.empty(len(order), bool)
    out[order] = many[group]
    return np.split(out, np.cumsum([k.shape[1] for k, _ in parts])[:-1])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    block, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "payload": pa.array(payload, pa.binary())})


def without_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 23, block_windows: int = 1 << 22, depth: int = 2, spare: int = 8, most_tasks: int = 100_000, keep_text: bool = False) -> DataFrame:
    """Takes out of every text each word that a repeated window covers: `window` consecutive words of one row whose sequence also starts anywhere else, in the same row too. Windows are judged on the input.

    Per row: its id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) and, with keep_text, `kept`. A word is a run of bytes other than ASCII white space.

    Rows are dealt by hash of id and text into buckets of about `bucket_bytes`; rows equal in both that together have more than that are counted and dealt once, with their count. Each bucket counts its windows into a count-min sketch of `depth` rows and about `spare` cells per window of the whole input, sent sparse and sorted; sketches merge by blocks of cells, and each bucket learns which of its cells reach two. Counts are never too low, so a window that the sketch calls single is single. The others go on with 128-bit hashes and are grouped exactly, again by blocks. Only the gaps between a bucket's cells are sent. A single window passes a row with a chance of about one in `spare`, and so all rows with one in `spare` to the power `depth`: 1 in 64 by default.
    The texts are shuffled once (the plan uses that exchange three times); nothing passes through the driver, and no task holds more than a bucket or a block, whose number grows with the input.
    Null or empty text: no words. Null or repeated ids and repeated rows: one result for each row, and repeated texts are repeats. Empty table: no rows. Other columns aren't read.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    size, hot, own = counted_often(own, bucket_bytes)
    buckets = max(1, -(-size // bucket_bytes))
    expected = max(1, size // 6)
    blocks = 1 << max(0, (expected // block_windows).bit_length())
    bits = min(60, max(blocks.bit_length(), (expected * spare).bit_length()))
    kind = docs.schema[id_col].dataType.simpleString()
    # As many partitions as buckets, up to most_tasks, however many the session has for other shuffles; a task holds one of its buckets at a time.
    tasks = -(-buckets // -(-buckets // most_tasks))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets))).repartition(tasks, "bucket").groupBy("bucket")
    schema = "block long, bucket long, payload binary"

    def cells(one: np.ndarray, row: int) -> np.ndarray:
        return mix(one ^ np.uint64(_ROWS[row])) >> np.uint64(64 - bits)

    def by_block(keys: np.ndarray, twice: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
        block = (keys[0] >> np.uint64(shift)).astype(np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(block[a]), slice(a, b)

    def text_column(table: pa.Table) -> pa.Array:
        return pa.concat_arrays(table["text"].chunks) if table.num_rows else pa.array([], pa.string())

    def often(table: pa.Table, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which windows are of a row that stands for several equal ones."""
        return np.repeat(table["n"].to_numpy() > 1, np.diff(first))[at]

    def sketch(table: pa.Table) -> pa.Table:
        bucket, rows = table["bucket"][0].as_py(), []
        (one, _), at, first = window_hashes(text_column(table), window)
        several = often(table, at, first)
        for row in range(depth):
            keys, twice = distinct(cells(one, row)[None], several)
            for block, part in by_block(keys, twice, bits - blocks.bit_length() + 1):
                rows.append((row * blocks + block, bucket, coded(keys[0][part], twice[part])))
        return _table(rows)

    def merged(read: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            block = table["block"][0].as_py()
            if block < 0:  # a bucket's first answer, on its way
                return table
            found = repeated([read(x.as_buffer()) for x in table["payload"]])
            return _table([(block, bucket, np.packbits(x).tobytes()) for bucket, x in zip(table["bucket"].to_pylist(), found, strict=True)])

        return merge

    def answers(table: pa.Table, low: int, high: int) -> dict[int, np.ndarray]:
        return {block: np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)) for block, x in zip(table["block"].to_pylist(), table["payload"], strict=True) if low <= block < high}

    def suspects(hashes: np.ndarray, answer: dict[int, np.ndarray]) -> np.ndarray:
        """Which windows every row of the merged sketch counts twice or more."""
        out = np.ones(hashes.shape[1], bool)
        for row in range(depth):
            own_cells = cells(hashes[0], row)
            keys, twice = distinct(own_cells[None])
            said = np.zeros(keys.shape[1], bool)
            for block, part in by_block(keys, twice, bits - blocks.bit_length() + 1):
                said[part] = answer[row * blocks + block][: part.stop - part.start]
            out &= said[np.searchsorted(keys[0], own_cells)]
        return out

    def exact(table: pa.Table, told: pa.Table) -> pa.Table:
        bucket, rows = table["bucket"][0].as_py(), []
        hashes, at, first = window_hashes(text_column(table), window)
        maybe = suspects(hashes, answers(told, 0, depth * blocks))
        keys, twice = distinct(hashes[:, maybe], often(table, at, first)[maybe])
        for block, part in by_block(keys, twice, 64 - blocks.bit_length() + 1 if blocks > 1 else 63):
            rows.append((block, bucket, np.array([part.stop - part.start]).tobytes() + keys[:, part].tobytes() + np.packbits(twice[part]).tobytes()))
        rows.append((-1 - bucket, bucket, np.packbits(maybe[np.argsort(hashes[0], kind="stable")]).tobytes()))
        return _table(rows)

    def read_exact(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return np.frombuffer(raw, np.uint64, 2 * n, 8).reshape(2, n), np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 + 16 * n), count=n).astype(bool)

    def read_cells(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        keys, twice = decoded(raw)
        return keys[None], twice

    def final(table: pa.Table, told: pa.Table) -> pa.Table:
        bucket, column = table["bucket"][0].as_py(), text_column(table)
        hashes, at, first = window_hashes(column, window)
        answer = answers(told, -1 - bucket, 1 << 62)
        maybe = np.zeros(hashes.shape[1], bool)
        maybe[np.argsort(hashes[0], kind="stable")] = answer[-1 - bucket][: hashes.shape[1]]
        keys, twice = distinct(hashes[:, maybe])
        said = np.zeros(keys.shape[1], bool)
        for block, part in by_block(keys, twice, 64 - blocks.bit_length() + 1 if blocks > 1 else 63):
            said[part] = answer[block][: part.stop - part.start]
        again = at[maybe][said[_places(keys, hashes[:, maybe])]]
        cover = np.zeros(first[-1] + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        hashed, removed, texts = [], [], []
        for k, text in enumerate(column.fill_null("").to_pylist()):
            words, part = text.encode().split(), gone[first[k] : first[k + 1]]
            removed.append(int(part.sum()))
            kept = b" ".join(compress(words, (~part).tolist()) if removed[-1] else words)
            hashed.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if keep_text else None)
        return pa.table({"id": table["id"], "n": table["n"], "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(hashed, pa.string()), "kept": pa.array(texts, pa.string())})

    counted = dealt.applyInArrow(sketch, schema).groupBy("block").applyInArrow(merged(read_cells), schema)
    grouped = dealt.cogroup(counted.groupBy("bucket")).applyInArrow(exact, schema).groupBy("block").applyInArrow(merged(read_exact), schema)
    out = dealt.cogroup(grouped.groupBy("bucket")).applyInArrow(final, f"id {kind}, n long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = as_often(out) if hot else out.drop("n")
    return (out if keep_text else out.drop("kept")).withColumnRenamed("id", id_col)


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted pair stands among the sorted distinct pairs, of which it is one."""
    at = np.searchsorted(keys[0], wanted[0])
    while len(at) and (wrong := keys[1][at] != wanted[1]).any():
        at = at + wrong
    return at
