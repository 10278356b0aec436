"""The trie of conversations' beginnings: compacted tries built in tasks, with nodes found by two-fattest handles, then expanded and merged."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairospark.llm.columns import stored

_SPACES = " \t\n\x0b\x0c\r"
_SIZE = 16
_ROOT = bytes(_SIZE)
#: Ids of one end are hashed in order of their value, in blocks of so many possible ids (a power of two).
_BLOCK = 17


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): for each conversation its turns in order, each a struct of a 128-bit hash of role and text, and the number of words in the text. turns: conv_id, turn, role, text.

    Ordered by turn, null first, then role and text; null role or text is empty. Rows without a conv_id take no part. Texts are sorted on disk where a conversation is long; what is gathered of a turn is 20 bytes.
    """
    own = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    trimmed = F.btrim("text", F.lit(_SPACES))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, _SIZE)
    placed = own.withColumn("k", F.row_number().over(order)).select("conv_id", F.struct("k", digest.alias("turn"), words.alias("words")).alias("x"))
    return placed.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["turn"].alias("turn"), x["words"].alias("words"))).alias("turns"))


def with_shared_heads(arrays: DataFrame, group: int = 20, kinds: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of c's host, then c's own after its first h. host: c - c % group; h: crc32 of c's decimal digits, modulo kinds. A host that isn't there gives none."""
    c = F.col("conv_id")
    hosts = arrays.where(c % group == 0).select(c.alias("host"), F.slice("turns", 1, kinds - 1).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % kinds).cast("int")
    own = arrays.withColumns({"host": c - c % group, "h": h}).join(hosts, "host", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), rest).alias("turns"))


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of paths, each given as the hashes of its beginnings (the empty one first).

    A node stands for the edge above it: depths over its parent's up to its own. `handles` finds it by the hash at the two-fattest depth of that range, so the deepest node that begins a path is found in as many lookups as the path's length has bits. `kids` finds the node below a place by the hash one turn further.
    """

    def __init__(self) -> None:
        self.depth, self.parent, self.path = [0], [-1], [[_ROOT]]
        self.handles: dict[bytes, int] = {}
        self.kids: dict[bytes, int] = {}

    def exit_node(self, path: list[bytes]) -> tuple[int, int]:
        """The deepest node that begins the path, and the node whose edge the path leaves at or before that node's end (-1: none, the path ends or leaves at the first)."""
        node, low, high = 0, 0, len(path) - 1
        while low < high:
            f = fattest(low, high)
            found = self.handles.get(path[f], -1)
            if found < 0:
                high = f - 1
            elif (d := self.depth[found]) < len(path) and path[d] == self.path[found][d]:
                node, low = found, d
            else:
                return self.parent[found], found
        return node, self.kids.get(path[low + 1], -1) if low + 1 < len(path) else -1

    def _placed(self, node: int, parent: int) -> None:
        path, above, d = self.path[node], self.depth[parent], self.depth[node]
        self.parent[node] = parent
        self.handles[path[fattest(above, d)]] = self.kids[path[above + 1]] = node

    def _new(self, path: list[bytes], depth: int, parent: int) -> int:
        self.depth.append(depth)
        self.parent.append(parent)
        self.path.append(path)
        self._placed(len(self.depth) - 1, parent)
        return len(self.depth) - 1

    def insert(self, path: list[bytes]) -> int:
        """The node at the path's end, which is made, and an edge split, where there is none."""
        node, left = self.exit_node(path)
        if left >= 0:
            other = self.path[left]
            low, high = self.depth[node] + 1, min(self.depth[left], len(path) - 1)
            while low < high:  # the last common depth of the path and the edge
                middle = (low + high + 1) // 2
                low, high = (middle, high) if path[middle] == other[middle] else (low, middle - 1)
            if low < self.depth[left]:
                node = self._new(other, low, node)
                self._placed(left, node)
            else:
                node = left
        return node if self.depth[node] == len(path) - 1 else self._new(path, len(path) - 1, node)

    def upwards(self) -> list[int]:
        """All nodes but the root, each before its parent."""
        return sorted(range(1, len(self.depth)), key=self.depth.__getitem__, reverse=True)


def _beginnings(packed: bytes) -> list[bytes]:
    return [_ROOT, *(packed[k : k + _SIZE] for k in range(0, len(packed), _SIZE))]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation the hashes of its beginnings and its words a turn, both packed, and the hash of the whole."""
    for batch in batches:
        column = batch.column("turns")
        ends, flat = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]), column.flatten()
        turns, words = flat.field("turn").to_pylist(), flat.field("words").to_numpy(zero_copy_only=False).astype("<i4")
        paths = []
        for low, high in zip(ends[:-1], ends[1:]):
            now, out = _ROOT, []
            for turn in turns[low:high]:
                now = hashlib.blake2b(now + turn, digest_size=_SIZE).digest()
                out.append(now)
            paths.append((now, b"".join(out), words[low:high].tobytes()))
        columns = list(zip(*paths)) or [(), (), ()]
        yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, pa.binary()) for c in columns)], ["conv_id", "whole", "path", "words"])


def _tries(make: Callable[[list[dict[str, Any]]], dict[str, list]], schema: pa.Schema, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows in batches of about `most` turns, each made one trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                held += len(row["path"]) // _SIZE + 1
                if held >= most:
                    yield from pa.table(make(rows), schema).to_batches()
                    rows, held = [], 0
        if rows:
            yield from pa.table(make(rows), schema).to_batches()

    return run


def _members(rows: list[dict[str, Any]]) -> dict[str, list]:
    """Of each beginning in the rows: its number of conversations and the least of them."""
    trie, words = ZFastTrie(), [np.zeros(1, np.int32)]
    n, least, of = [0], [1 << 63], {}
    for row in rows:
        path = _beginnings(row["path"])
        node, known = trie.insert(path), len(n)
        of[id(path)] = [0, *np.frombuffer(row["words"], "<i4").tolist()]
        n += [0] * (len(trie.depth) - known)
        least += [1 << 63] * (len(trie.depth) - known)
        n[node] += row["copies"]
        least[node] = min(least[node], row["conv_id"])
    for node in trie.upwards():
        up = trie.parent[node]
        n[up] += n[node]
        least[up] = min(least[up], least[node])
    out: dict[str, list] = {"node": [_ROOT], "parent": [None], "depth": [0], "words": [0], "n": [n[0]], "conv_id": [least[0]]}
    for node in range(1, len(n)):
        path, low, high = trie.path[node], trie.depth[trie.parent[node]], trie.depth[node]
        out["node"] += path[low + 1 : high + 1]
        out["parent"] += path[low:high]
        out["depth"] += range(low + 1, high + 1)
        out["words"] += of[id(path)][low + 1 : high + 1]
        out["n"] += [n[node]] * (high - low)
        out["conv_id"] += [least[node]] * (high - low)
    return out


def _below(rows: list[dict[str, Any]]) -> dict[str, list]:
    """Of each beginning in the rows, what its conversations add to the counts of what is below it.

    A node belongs to its least conversation, which then has all further nodes of its own path too, from depth `top` on. So every node of a subtree is counted once, at the conversation that it belongs to, and of a node's conversations in these rows the least alone can have it.
    """
    trie = ZFastTrie()
    n, words, saved, own, leaves, kids = [0], [0], [0], [0], [0], [0]
    least: list[tuple[int, int, int, int] | None] = [None]  # conversation, top, words of its own nodes, words from here on
    of: dict[int, list[int]] = {}
    for row in rows:
        path, w = _beginnings(row["path"]), [0, *np.frombuffer(row["words"], "<i4").tolist()]
        node, known = trie.insert(path), len(n)
        of[id(path)] = w
        for column, blank in ((n, 0), (saved, 0), (own, 0), (leaves, 0), (kids, 0), (least, None)):
            column += [blank] * (len(trie.depth) - known)
        mine = sum(w[row["top"] :]) if row["top"] < len(w) else 0
        n[node] += row["copies"]
        saved[node] += row["copies"] * w[-1]
        own[node] += mine
        leaves[node] += row["leaf"]
        least[node] = min(filter(None, (least[node], (row["conv_id"], row["top"], mine, w[-1]))))
    out: dict[str, list] = {"node": [], "leaves": [], "saved": [], "kids": []}
    for node in [*trie.upwards(), 0]:
        up, high, path = trie.parent[node], trie.depth[node], trie.path[node]
        low = trie.depth[up] if node else -1
        w, (c, top, mine, rest), further = of.get(id(path), [0]), least[node], 0
        for d in range(high, low, -1):
            if d < high:
                further += w[d]
            out["node"].append(path[d])
            out["leaves"].append(leaves[node])
            out["saved"].append(saved[node] + n[node] * further - own[node] + mine - (rest + further if top <= d else mine))
            out["kids"].append(kids[node] if d == high else int(top <= d + 1))
        if node:
            further += w[low]
            n[up] += n[node]
            saved[up] += saved[node] + n[node] * further
            own[up] += own[node]
            leaves[up] += leaves[node]
            kids[up] += top <= low + 1
            least[up] = min(filter(None, (least[up], (c, top, mine, rest + further))))
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's ids, whose blocks come in order; no more than a block is held."""
    now, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for whole, ids in zip(batch.column("whole").to_pylist(), batch.column("ids").to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if whole == now:
                digest.update(b"," + text)
                continue
            if now is not None:
                done.append((now, digest.hexdigest()))
            now, digest = whole, hashlib.sha256(text)
        yield pa.record_batch([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(arrays: DataFrame, *, batch_turns: int = 1 << 17) -> DataFrame:
    """A row for each distinct beginning of the conversations: conv_id (its least one), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over its subtree: words of a turn times its repetitions) and ends_sha256 (of the ids that end there, ascending, joined by commas). arrays: conv_id, turns, as of turn_arrays(); ids are distinct.

    Equal conversations are counted first. Then each task puts its conversations into compacted tries of about `batch_turns` turns, expands their edges, and the rows of one beginning, named by a 128-bit hash, are added up over all tasks: a beginning that a third of all conversations share is a row or two from each task. What depends on the subtree is added up the same way in a second pass, after every conversation knows which nodes it is the least of, so there is no round for each depth. Each conversation's hashes and words (20 bytes a turn) are in one task. The ids of one end are grouped by blocks of their value and hashed block by block.
    A conversation without turns ends at the root. Empty table: no rows, not even a root. Null arrays: without turns. Null ids: left out.
    """
    own = arrays.where("conv_id is not null").select("conv_id", F.coalesce("turns", F.slice("turns", 1, 0), F.array().cast(arrays.schema["turns"].dataType)).alias("turns"))
    paths = stored(own.mapInArrow(_hashed, "conv_id long, whole binary, path binary, words binary"))
    firsts = paths.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")).drop("whole")
    each = _tries(_members, pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64())]), batch_turns)
    seen = paths.join(firsts, "conv_id").select("conv_id", "copies", "path", "words").mapInArrow(each, "node binary, parent binary, depth long, words long, n long, conv_id long")
    nodes = stored(seen.groupBy("node", "parent", "depth").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max_by("n_convs", "depth").alias("last"))
    facts = firsts.join(tops, "conv_id", "left").select("conv_id", "copies", F.coalesce("top", F.lit(1 << 40)).alias("top"), F.when(F.col("last") == F.col("copies"), 1).otherwise(0).alias("leaf"))
    below = _tries(_below, pa.schema([("node", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64()), ("kids", pa.int64())]), batch_turns)
    sums = paths.select("conv_id", "path", "words").join(facts, "conv_id").mapInArrow(below, "node binary, leaves long, saved long, kids long").groupBy("node").agg(F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    blocks = paths.groupBy("whole", F.shiftright("conv_id", _BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ends = blocks.repartition("whole").sortWithinPartitions("whole", "block").mapInArrow(_ends, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
