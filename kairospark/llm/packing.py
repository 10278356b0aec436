"""Packing token streams into fixed windows: bounded-space online best fit."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import slices, stored, utf8
from kairospark.llm.hashing import ALNUM, OTHER_BYTES, word_hashes

_FIELDS = {"doc": None, "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "open": pa.bool_(), "ids": pa.list_(pa.int32())}
_LOADED: dict[str, WordEncoder] = {}


# Bytes at which a text is cut into units that never share a token, whatever stands around them: at space and line feed, which the tokenizer drops, and between an ASCII letter or digit, or a letter of U+00C0 to U+00FF, and a full stop or comma.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_PLAIN = ALNUM.copy()
_PLAIN[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each unit, and for each row the index of its first unit (one entry more than rows)."""
    solid, stop, word = ~_GAP[data], _STOP[data], _PLAIN[data]
    ends_word = word.copy()
    if len(data) > 1:
        ends_word[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data) + 1, bool)  # before this byte
    cut[1:-1] = solid[1:] != solid[:-1]
    cut[1:-1] |= stop[1:] & ends_word[:-1] | word[1:] & stop[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    keep = solid[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


class WordEncoder:
    """Token ids by a tokenizer that drops white space and lower-cases: a text's ids are those of its units, one after the other, so a unit is encoded once and looked up afterwards, many at a time.

    Units are known by two 64-bit hashes of their bytes, ASCII capitals as small letters. The table is emptied at `most` units, which bounds the memory and changes no result. Texts with marks of special strings, which are looked for before lower-casing, are encoded whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self, slots: int = 1 << 16) -> None:
        self.n, self.filled = 0, 0
        self.pool = np.zeros(1 << 18, self.kind)
        self.keys = np.zeros((2, slots), np.uint64)
        self.place, self.length = np.zeros(slots, np.int32), np.full(slots, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out, mask = np.full(keys.shape[1], -1, np.int64), np.uint64(len(self.place) - 1)
        left, slot = np.arange(keys.shape[1]), (keys[0] & mask).astype(np.int64)
        while len(left):
            same = (self.keys[0][slot] == keys[0][left]) & (self.keys[1][slot] == keys[1][left]) & (self.length[slot] >= 0)
            out[left[same]] = slot[same]
            go = ~same & (self.length[slot] >= 0)
            left, slot = left[go], (slot[go] + 1) & int(mask)
        return out

    def put(self, keys: np.ndarray, place: np.ndarray, length: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(length)) > len(self.place):
            held = np.flatnonzero(self.length >= 0)
            old = self.keys[:, held], self.place[held], self.length[held]
            slots = len(self.place)
            while 2 * (self.n + len(length)) > slots:
                slots *= 2
            self.keys, self.place, self.length = np.zeros((2, slots), np.uint64), np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
            self.n = 0
            self.put(*old)
        mask, left = len(self.place) - 1, np.arange(len(length))
        slot = (keys[0] & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.length[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            at, which = slot[own], left[own]
            self.keys[:, at], self.place[at], self.length[at] = keys[:, which], place[which], length[which]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, slot = left[rest], (slot[rest] + 1) & mask
        self.n += len(length)

    def learn(self, words: list[str], keys: np.ndarray) -> None:
        """Encodes unseen units, many in one call; offsets tell which ids are whose."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            code = self.tokenizer.encode_batch([" ".join(part)], add_special_tokens=False)[0]
            n = len(code.ids)
            while self.filled + n > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.filled : self.filled + n] = code.ids
            at = np.fromiter((a for a, _ in code.offsets), np.int64, n)
            bounds = np.searchsorted(at, np.cumsum([0, *(len(w) + 1 for w in part)]))
            self.put(keys[:, k : k + 2000], self.filled + bounds[:-1], np.diff(bounds))
            self.filled += n

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row; null as empty."""
        special = np.flatnonzero(pc.match_substring(column, "<|").fill_null(False).to_numpy(zero_copy_only=False))
        data, offsets = utf8(column)
        starts, ends, first = units(data, offsets)
        data = _LOWER[data]
        keys = np.stack([word_hashes(data, starts, ends), word_hashes(data, starts, ends, OTHER_BYTES)])
        if self.n > self.most:
            self.clear()
        slot = self.find(keys)
        if len(new := np.flatnonzero(slot < 0)):
            _, once = np.unique(keys[0][new], return_index=True)
            once, raw, slots = new[once], data.tobytes(), len(self.place)
            self.learn([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)], keys[:, once])
            if len(self.place) == slots:
                slot[new] = self.find(keys[:, new])
            else:  # a larger table
                slot = self.find(keys)
        length = self.length[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.place[slot] - upto[:-1], length) + np.arange(upto[-1])]
        out = np.split(ids, upto[first[1:-1]])
        for row in special.tolist():
            out[row] = np.array(self.tokenizer.encode(column[row].as_py(), add_special_tokens=False).ids, self.kind)
        return out


class Windows:
    """At most `most` open windows of `size`; each piece goes to the one that it fills best."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.n = 0

    def fullest(self) -> tuple[int, int]:
        return self.open[0]

    def close(self) -> list:
        """The fullest window's pieces; it is open no longer."""
        return self.held.pop(self.open.pop(0)[1])

    def fits(self, length: int) -> int | None:
        k = bisect.bisect_left(self.open, (length, -1))
        return k if k < len(self.open) else None

    def put(self, length: int, piece, k: int | None = None) -> list | None:
        """Places a piece in the k-th open window or in a new one; gives the window's pieces if that filled it."""
        if k is None:
            room, number = self.size, self.n
            self.n += 1
            self.held[number] = []
        else:
            room, number = self.open.pop(k)
        self.held[number].append(piece)
        if room == length:
            return self.held.pop(number)
        bisect.insort(self.open, (room - length, number))
        return None


def placed(pieces: Iterable[tuple[int, object]], size: int, most: int, cut=None, least: int = 1) -> Iterator[tuple[bool, list]]:
    """(still open, pieces) of each window: best fit among `most` open windows. When a piece fits none and no more may open, the fullest is emitted; with `cut` the piece first fills that window's room if both parts are `least` long."""
    own = Windows(size, most)
    for length, piece in pieces:
        while True:
            k = own.fits(length)
            if k is None and len(own.open) >= most:
                room = own.fullest()[0]
                if cut and room >= least and length - room >= least:
                    head, piece = cut(piece, room)
                    yield False, own.put(room, head, 0)
                    length -= room
                    continue
                yield False, own.close()
            if (full := own.put(length, piece, k)) is not None:
                yield False, full
            break
    for _, number in own.open:
        yield True, own.held[number]


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, open_windows: int = 64, least: int = 16, merge_windows: int = 4096, keep_ids: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """Packs every row's token ids, then `end_id`, into sequences of at most `size` tokens. One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the ids.

    Online in each partition: `open_windows` windows are open at most, a piece goes where it fits best, and when none fits the fullest is emitted, its room filled by the head of that piece unless a part would be under `least` tokens. The windows still open at a partition's end are merged in groups of about `merge_windows`, best fit decreasing, without cutting: one small shuffle, and no task sees more than its group, whatever the input.
    Null text: empty, so the end id alone. Null id: kept as null; repeated rows are packed once each. Empty table: no rows. Other columns aren't read. A long text is cut into full windows first.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordEncoder(tokenizer)
        encode = _LOADED[tokenizer]
        number = (TaskContext.get().partitionId() + 1) << 36
        own_type = None
        ready: list[tuple] = []

        def stream() -> Iterator[tuple[int, tuple]]:
            nonlocal own_type
            for batch in slices(batches, "text", batch_bytes):
                own_type = batch.column("doc").type
                for doc, ids in zip(batch.column("doc").to_pylist(), encode(batch.column("text")), strict=True):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                    for at in range(0, len(ids), size):
                        yield min(size, len(ids) - at), (doc, at, ids[at : at + size], len(ids))

        def cut(piece: tuple, room: int) -> tuple[tuple, tuple]:
            doc, at, ids, n = piece
            return (doc, at, ids[:room], n), (doc, at + room, ids[room:], n)

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            return pa.record_batch([pa.array(c, own_type if t is None else t) for c, t in zip(columns, _FIELDS.values(), strict=True)], list(_FIELDS))

        for still, window in placed(stream(), size, open_windows, cut, least):
            offset, number = 0, number + 1
            for doc, at, ids, n in window:
                ready.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), n, number, offset, still, ids.astype(np.int32) if keep_ids else None))
                offset += len(ids)
            if len(ready) >= (500 if keep_ids else 20_000):
                yield out()
                ready.clear()
        if ready:
            yield out()

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        """Windows still open, as whole blocks: best fit decreasing, all windows kept open."""
        table = table.sort_values(["sequence_id", "offset"], ignore_index=True)
        blocks = table.groupby("sequence_id", sort=False)["length"].sum().sort_values(ascending=False, kind="stable")
        offsets, into, n = {}, {}, 0
        for _, window in placed(((int(v), (int(k), int(v))) for k, v in blocks.items()), size, len(blocks) + 1):
            n, at = n + 1, 0
            for block, length in window:
                offsets[block], into[block], at = at, window[0][0], at + length
        table["offset"] += table["sequence_id"].map(offsets)
        table["sequence_id"] = table["sequence_id"].map(into)
        return table

    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids array<int>"
    pieces = stored(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).mapInArrow(run, schema))
    # Neighbouring partitions merge: each has at most open_windows left.
    group = F.expr(f"shiftright(sequence_id, 36) div {max(1, merge_windows // open_windows)}")
    merged = pieces.where("open").withColumn("part", group).groupBy("part").applyInPandas(lambda t: merge(t.drop(columns="part")), schema)
    out = pieces.where("not open").unionByName(merged).drop("open")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("doc", id_col)
