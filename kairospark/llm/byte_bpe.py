"""Byte-level BPE of whole texts as a tree reduction: halves are encoded, and neighbours joined at their boundary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.llm.columns import lists, slices, strings

# Characters whose kind is the same in every version of the Unicode tables.
_LETTER = r"A-Za-z\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_MARK = r"!-&(-/:-@\[-`{-~\u3001\u3002\uFF01\uFF08\uFF09\uFF0C\uFF1A\uFF1B\uFF1F"
#: Places where a match always ends, whatever stands around, and that don't change the matches on either side: before white space, after a letter that no letter follows, after a digit before a letter, after a mark (other than an apostrophe, which may begin a contraction) before a letter or digit.
_PLACES = rf"(?<=\P{{White_Space}})(?=\p{{White_Space}})|(?<=[{_LETTER}])(?=[{_MARK}'0-9])|(?<=[0-9])(?=[{_LETTER}])|(?<=[{_MARK}])(?=[{_LETTER}0-9])"
_ANCHOR, _ANCHOR_BACK = regex.compile(_PLACES), regex.compile(f"(?r){_PLACES}")
_LOADED: dict[tuple[str, str], Bpe] = {}


class Bpe:
    """Encoding by merge ranks, each match of a pattern by itself.

    Inside one match, tokens t1..tn are the encoding of their bytes exactly if each neighbouring pair is that of its own two tokens' bytes: merges are taken by rank, then place, so up to the first merge across a boundary the bytes of the two tokens beside it go through the same states as if they stood alone. So a join is right once the pairs at the edges of what was encoded again hold, and all others are untouched.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks, self.tokens = ranks, {r: b for b, r in ranks.items()}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))  # as the library reads them
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        for r, b in self.tokens.items():
            self.lengths[r] = len(b)
        self.holds = lru_cache(1 << 16)(self._holds)

    @staticmethod
    def load(path: str, pattern: str) -> Bpe:
        """Read once in each worker."""
        if (path, pattern) not in _LOADED:
            with open(path, "rb") as f:
                _LOADED[path, pattern] = Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}, pattern)
        return _LOADED[path, pattern]

    def merged(self, data: bytes) -> list[int]:
        """By merges alone, for few bytes: again and again the pair of least rank, the leftmost first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def piece(self, data: bytes) -> list[int]:
        """Bytes inside one match; bytes that are a token are merged all the same, as a whole match alone is looked up first."""
        if not data:
            return []
        return self.merged(data) if data in self.ranks else self.library._encode_single_piece(data)

    def _holds(self, a: int, b: int) -> bool:
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """Decoding: the halves' bytes one after the other."""
        if len(ids) <= 1 << 12:
            return self.library.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.bytes_of(ids[:half]) + self.bytes_of(ids[half:])

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of two neighbouring stretches of one match, from each one's: the boundary's tokens are encoded again, twice as many at the side whose edge doesn't hold yet, until both edges hold or the stretch ends."""
        if not len(a) or not len(b):
            return np.concatenate([a, b])
        left = right = 1
        if self.holds(int(a[-1]), int(b[0])):
            return np.concatenate([a, b])
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            new = self.piece(self.bytes_of(np.concatenate([a[-left:], b[:right]])))
            low = left == len(a) or self.holds(int(a[-left - 1]), new[0])
            high = right == len(b) or self.holds(new[-1], int(b[right]))
            if low and high:
                return np.concatenate([a[: len(a) - left], np.array(new, np.uint32), b[right:]])
            left, right = left if low else 2 * left, right if high else 2 * right

    def stretch(self, data: bytes, most: int) -> np.ndarray:
        """Tokens of bytes inside one match, by halves."""
        if len(data) <= most:
            return np.array(self.piece(data), np.uint32)
        half = len(data) // 2
        return self.joined(self.stretch(data[:half], most), self.stretch(data[half:], most))

    def match(self, text: str, most: int) -> np.ndarray:
        """Tokens of one whole match."""
        data = text.encode()
        return np.array([self.ranks[data]], np.uint32) if data in self.ranks else self.stretch(data, most)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.uint32)

    def encode(self, text: str, leaf: int = 4096) -> np.ndarray:
        """Token ids of a text. Up to `leaf` characters are encoded at once; a longer text by halves."""
        return self._encode(text, 0, len(text), leaf)

    def _encode(self, text: str, low: int, high: int, leaf: int) -> np.ndarray:
        if high - low <= leaf:
            return self.plain(text[low:high])
        half = (low + high) // 2
        a, b = self._encode(text, low, half, leaf), self._encode(text, half, high, leaf)
        return self._joined(text, low, half, high, a, b, leaf)

    def _joined(self, text: str, low: int, half: int, high: int, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
        """Tokens of text[low:high] from those of its two halves.

        The window about the boundary grows until both ends are anchors, or ends of the text: what is outside is then settled. A window longer than a leaf has long matches inside: its matches are found anew, and their tokens come from the halves' as far as those are inside, joined by pairs that hold.
        """
        if _ANCHOR.match(text, half):
            return np.concatenate([a, b])
        size = min(32, leaf)
        while True:
            near, far = max(low, half - size), min(high, half + size)
            left = _ANCHOR_BACK.search(text, near, half)
            right = _ANCHOR.search(text, half + 1, far)
            start = left.start() if left else low if near == low else None
            end = right.start() if right else high if far == high else None
            if start is not None and end is not None or 2 * size > leaf:
                break
            size *= 2
        if start is not None and end is not None:
            cut_a, cut_b = len(self.plain(text[start:half])), len(self.plain(text[half:end]))
            return np.concatenate([a[: len(a) - cut_a], self.plain(text[start:end]), b[cut_b:]])
        start = m.start() if (m := _ANCHOR_BACK.search(text, low, half)) else low
        end = m.start() if (m := _ANCHOR.search(text, half + 1, high)) else high
        return self._long(text, start, half, end, a, b, leaf)

    def _long(self, text: str, start: int, half: int, end: int, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
        """As _joined() for a window from start to end, both settled, with matches longer than a leaf."""
        n_a = len(text[start:half].encode())
        n_b = len(text[half:end].encode())
        back = np.cumsum(self.lengths[a[::-1]])
        cut_a = len(a) - (int(np.searchsorted(back, n_a)) + 1 if n_a else 0)
        cut_b = int(np.searchsorted(np.cumsum(self.lengths[b]), n_b)) + 1 if n_b else 0
        out = [a[:cut_a]]
        old = self._spans(text, start, half, a[cut_a:]) + self._spans(text, half, end, b[:cut_b])
        k = 0
        for m in self.pattern.finditer(text, start, end):
            low, high, tokens = m.start(), m.end(), np.zeros(0, np.uint32)
            if high - low <= leaf:
                out.append(self.match(m.group(), leaf))
                continue
            while old[k][1] <= low:
                k += 1
            at = k
            while at < len(old) and old[at][0] < high:
                tokens = self.joined(tokens, self._inside(text, old[at], max(low, old[at][0]), min(high, old[at][1]), leaf))
                at += 1
            data = self.bytes_of(tokens) if len(tokens) < 64 else b""
            out.append(np.array([self.ranks[data]], np.uint32) if data in self.ranks else tokens)
        return np.concatenate([*out, b[cut_b:]])

    def _spans(self, text: str, start: int, end: int, tokens: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """The matches of text[start:end] alone, each with its share of the tokens."""
        out, used, ends, at = [], 0, np.cumsum(self.lengths[tokens]), 0
        for m in self.pattern.finditer(text[start:end]):
            used += len(m.group().encode())
            upto = int(np.searchsorted(ends, used)) + 1
            out.append((start + m.start(), start + m.end(), tokens[at:upto]))
            at = upto
        return out

    def _inside(self, text: str, old: tuple[int, int, np.ndarray], low: int, high: int, leaf: int) -> np.ndarray:
        """Tokens of text[low:high], a part of an old match: its tokens that lie inside as they are, for every pair of them holds, and what sticks out encoded and joined."""
        begin, end, tokens = old
        if (low, high) == (begin, end):
            return tokens if len(tokens) > 1 else np.array(self.piece(text[low:high].encode()), np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.lengths[tokens])])
        a, b = len(text[begin:low].encode()), len(text[begin:high].encode())
        data = text[low:high].encode()
        i, j = int(np.searchsorted(ends, a)), int(np.searchsorted(ends, b, "right")) - 1
        if i >= j:
            return self.stretch(data, leaf)
        head, tail = data[: int(ends[i]) - a], data[int(ends[j]) - a :]
        return self.joined(self.joined(np.array(self.piece(head), np.uint32), tokens[i:j]), np.array(self.piece(tail), np.uint32))


def encoded(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, leaf: int = 4096, batch_bytes: int = 1 << 20) -> DataFrame:
    """Per row of docs: its id, and ids, the tokens of its whole text by the ranks of a file, special strings as ordinary text: an array, or packed as binary of little-endian unsigned 32-bit numbers.

    A text longer than `leaf` characters is encoded by halves, and neighbours are joined at their boundary (Bpe.encode()), so the library never gets more than a leaf or a window of one, however long a run of one kind of characters is.
    Null text: as empty, no tokens. Null id: kept as null. Repeated rows: one result each. Empty table: no rows. Other columns aren't read. One narrow pass, no shuffle; a worker holds a batch of about `batch_bytes` of text, or one longer text, and its tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(ranks, pattern)
        for batch in slices(batches, "text", batch_bytes):
            tokens = [bpe.encode(x, leaf).astype("<u4") for x in strings(batch.column("text"))]
            if packed:
                out = pa.array([t.tobytes() for t in tokens], pa.binary())
            else:
                out = lists(np.concatenate(tokens).astype(np.int32), np.cumsum([0, *map(len, tokens)]))
            yield pa.record_batch([batch.column("id"), out], ["id", "ids"])

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}").withColumnRenamed("id", id_col)


def decoded(df: DataFrame, ranks: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with a binary column more: the bytes of its token ids, an array or packed. Null ids: no bytes. A number that is no token raises. One narrow pass; the other columns go through as they are."""
    if out_col in df.columns:
        raise ValueError(f"a column {out_col} is there already")
    kind = "binary" if dict(df.dtypes)[ids_col] == "binary" else "array<int>"
    schema = df.withColumn(out_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(ranks, pattern)
        for batch in batches:
            rows = batch.column(ids_col).to_pylist() if kind == "binary" else batch.column(ids_col)
            numbers = [np.frombuffer(x or b"", "<u4") if kind == "binary" else np.array(x.as_py() or [], np.uint32) for x in rows]
            yield batch.append_column(out_col, pa.array([bpe.bytes_of(n) for n in numbers], pa.binary()))

    return df.mapInArrow(run, schema)
