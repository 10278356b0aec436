"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import slices, utf8
from kairospark.llm.hashing import ALNUM, windows, word_hashes, word_spans

_BITMAP = 20


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each row, lower-case runs of letters and digits, where each row's words begin, and the lower-case bytes, where each row's bytes begin, and the words' places."""
    data, offsets = utf8(pc.utf8_lower(column.fill_null("")))
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), first, data, offsets, starts, ends


def myers(pattern: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int]:
    """(least edit distance, end) of the pattern against any part of the text, by Myers' bit-parallel columns: one bit for each word of the pattern, which words it has at which bits. Of equal distances the first end; (most + 1, 0) if none is within `most`."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, 0
    for k, word in enumerate(text, 1):
        eq = pattern.get(word, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, k
    return best, end


def bits(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


@dataclass
class Item:
    key: int
    words: list[int]
    budget: int
    forward: dict[int, int] = field(default_factory=dict)
    backward: dict[int, int] = field(default_factory=dict)


class Matcher:
    """Items cut into budget + 1 pieces each. At least one piece of a passage within the budget is untouched; its first `seed` words, or all of a shorter piece, are looked up, then the whole piece, then the passage's distance."""

    def __init__(self, keys: list[int], texts: pa.Array, rate: float, seed: int, least: int):
        if not 0 <= rate < 1:
            raise ValueError("the budget is a share of an item's words: 0 or more, under 1")
        words, first, *_ = words_of(texts)
        self.items: list[Item] = []
        #: By length of the looked-up run: its hash, and the pieces that begin with it.
        self.pieces: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for key, a, b in zip(keys, first[:-1], first[1:], strict=True):
            own = words[a:b]
            if len(own) < least:
                continue
            item = Item(key, own.tolist(), int(rate * len(own)))
            item.forward, item.backward = bits(item.words), bits(item.words[::-1])
            n = item.budget + 1
            cuts = [len(own) * k // n for k in range(n + 1)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                run = min(seed, y - x)
                self.pieces.setdefault(run, {}).setdefault(int(windows(own[x : x + run], run)[0]), []).append((len(self.items), x, y))
            self.items.append(item)
        self.maps = {}
        for run, table in self.pieces.items():
            self.maps[run] = np.zeros(1 << _BITMAP, bool)
            self.maps[run][np.array(list(table), np.uint64) >> np.uint64(64 - _BITMAP)] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, piece start in the item, place in the row) of exact pieces."""
        for run, table in self.pieces.items():
            found = windows(words, run)
            near = np.flatnonzero(self.maps[run][found >> np.uint64(64 - _BITMAP)])
            rows = np.searchsorted(first, near, "right") - 1
            for at, row, h in zip(near.tolist(), rows.tolist(), found[near].tolist(), strict=True):
                for number, x, y in table.get(h, ()):
                    if at + y - x <= first[row + 1] and words[at : at + y - x].tolist() == self.items[number].words[x:y]:
                        yield row, number, x, at - int(first[row])

    def best(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """For each row and item key with a passage within the budget: (distance, start, end, number of the item's words), start and end in words of the row; the least distance, then the first place."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, number, x, at in self.hits(words, first):
            item = self.items[number]
            n, size = len(item.words), int(first[row + 1] - first[row])
            low, high = max(0, at - x - item.budget), min(size, at - x + n + item.budget)
            if (row, number) in seen and any(a <= low and high <= b for a, b in seen[row, number]):
                continue
            seen.setdefault((row, number), []).append((low, high))
            text = words[first[row] + low : first[row] + high].tolist()
            distance, end = myers(item.forward, n, text, item.budget)
            if distance > item.budget:
                continue
            _, back = myers(item.backward, n, text[:end][::-1], distance)
            new = (distance, low + end - back, low + end, n)
            if new < out.get((row, item.key), (n + 1,)):
                out[row, item.key] = new
        return out


def item_blocks(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[tuple[list[int], pa.Array]]:
    """The distinct items in blocks that the driver can hold and send: at most about `most_items` items and `most_bytes` bytes of text in each, however many there are."""
    own = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // most_items), -(-size // most_bytes))
    for k in range(blocks):
        got = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield got["item_id"].to_pylist(), got["text"].combine_chunks()


def _matchers(items: DataFrame, rate: float, seed: int, least: int, most_items: int, most_bytes: int) -> Iterator[Matcher]:
    for keys, texts in item_blocks(items, most_items, most_bytes):
        kept = [k for k, key in enumerate(keys) if key is not None]
        yield Matcher([keys[k] for k in kept], texts.take(pa.array(kept, pa.int64())), rate, seed, least)


def contaminated(docs: DataFrame, items: DataFrame, *, rate: float = 0.2, seed: int = 4, least: int = 1, most_items: int = 20_000, most_bytes: int = 1 << 25) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start, end) for each row of docs and benchmark item of which the row holds a passage within the item's error budget: the least word edit distance and where it is, start and end in code points of the text.

    Words are lower-case runs of letters and digits, so case, white space and marks don't matter; an edit puts in, takes out or changes a word. The budget is `rate` of the item's words, rounded down; `seed` only says how many words of a piece are looked up first. Items under 5 words have no budget and match exactly, wherever their words stand; `least` leaves out items under so many words, if such short ones aren't wanted. Items without words match nothing.
    Items travel in blocks of bounded size, each one pass over docs; there is no shuffle. Null or empty text: no match. Null item id or text: no item. Null doc id: kept as null. Repeated documents: one result each; repeated items count once. Empty tables: no rows. Other columns aren't read.
    """
    sc, out = docs.sparkSession.sparkContext, None
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, n_words int, start long, end long"
    for matcher in _matchers(items, rate, seed, least, most_items, most_bytes):
        shared = sc.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                words, first, data, offsets, starts, ends = words_of(batch.column("text"))
                found = shared.value.best(words, first)
                if not found:
                    continue
                rows, spans = [], []
                for (row, key), (distance, a, b, n) in sorted(found.items()):
                    begin, stop = starts[first[row] + a], ends[first[row] + b - 1]
                    start, size = (int(((x & 0xC0) != 0x80).sum()) for x in (data[offsets[row] : begin], data[begin:stop]))
                    spans.append((start, start + size))
                    rows.append((row, key, distance, n))
                row, key, distance, n = zip(*rows, strict=True)
                start, end = zip(*spans, strict=True)
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), pa.array(key, pa.int64()), pa.array(distance, pa.int32()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "n_words", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, *, rate: float = 0.2, seed: int = 4, least: int = 1, most_items: int = 20_000, most_bytes: int = 1 << 25) -> DataFrame:
    """The rows of docs that hold no passage of any item, all columns as they are; see contaminated(). No shuffle."""
    sc = docs.sparkSession.sparkContext
    for matcher in _matchers(items, rate, seed, least, most_items, most_bytes):
        shared = sc.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                words, first, *_ = words_of(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in shared.value.best(words, first)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
