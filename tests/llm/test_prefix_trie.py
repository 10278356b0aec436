"""The trie of conversations' beginnings against plain code, and the z-fast trie against sets of beginnings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairospark.llm.prefix_trie import _ROOT, ZFastTrie, fattest, prefix_trie, turn_arrays, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def path(symbols):
    out = [_ROOT]
    for s in symbols:
        out.append(hashlib.blake2b(out[-1] + s.encode(), digest_size=16).digest())
    return out


def test_fattest():
    for b in range(1, 200):
        for a in range(b):
            most = max(range(a + 1, b + 1), key=lambda x: x & -x)
            assert fattest(a, b) == most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=9) | st.sampled_from(["a" * 40, "a" * 33 + "b", "b" * 17]), max_size=30))
def test_the_trie_is_that_of_the_inserted_paths(words):
    trie = ZFastTrie()
    ends = [trie.insert(path(w)) for w in words]
    assert all(trie.path[e][: trie.depth[e] + 1] == path(w) for e, w in zip(ends, words))
    every = {w[:d] for w in words for d in range(len(w) + 1)}
    kids = {p: {q for q in every if len(q) == len(p) + 1 and q.startswith(p)} for p in every}
    compact = {p for p in every if p and (p in words or len(kids[p]) > 1)}
    assert {trie.path[k][trie.depth[k]] for k in range(1, len(trie.depth))} == {path(p)[-1] for p in compact}
    # every node is found at its handle, and no handle is left over
    assert {v: trie.path[v][fattest(trie.depth[trie.parent[v]], trie.depth[v])] for v in range(1, len(trie.depth))} == {v: h for h, v in trie.handles.items()}
    for w in [*words, "ab" * 12, "a" * 36, "b", ""]:
        node, left = trie.exit_node(path(w))
        deepest = max((p for p in compact | {""} if w.startswith(p)), key=len)
        assert trie.depth[node] == len(deepest)
        assert (left >= 0) == any(q.startswith(w[: len(deepest) + 1]) for q in every if len(q) > len(deepest) < len(w))


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        host = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(host, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ids = lambda p: ",".join(map(str, sorted(c for c in members[p] if built[c] == p)))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ids(p).encode()).hexdigest()) for p, m in members.items()), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    if rows:
        df = df.repartition(3)
    return sorted(map(tuple, prefix_trie(with_shared_heads(turn_arrays(df)), **how).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["hello there", " \t\n", "", None, "a  b\nc", "é " * 4000, "ok"]
    out = []
    for c in [*range(-45, 90), 1000, 1001, 1019, 7_000_001, 7_000_020]:
        if c % 20 == 0 and c % 40:
            continue  # some hosts are missing
        for k in range(rng.choice([1, 1, 2, 3, 6, 9])):
            out.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    out += [(12, None, "system", "first"), (12, None, "system", "first"), (12, 0, "user", "tie"), (12, 0, "user", "also"), (None, 0, "user", "nobody's")]
    return out + [(c, k, "user", f"long {k % 50 if c < 302 else k}") for c in (300, 301, 302) for k in range(400)]


@pytest.mark.parametrize("batch", [1, 30, 1 << 17])
def test_against_plain_code(spark, rows, batch):
    assert found(spark, rows, batch_turns=batch) == brute(rows)


def test_copies_and_a_common_first_turn(spark):
    rows = [(c, k, "user", t) for c in range(1, 2000) for k, t in enumerate(["hi"] + ["same"] * (c % 3 == 0) + [f"x{c}"] * (c % 3 == 1))]
    assert found(spark, rows, batch_turns=100) == brute(rows)


def test_ids_far_apart_are_in_order(spark):
    rows = [(c, 0, "user", "hi") for c in (5, -5, 1 << 40, -(1 << 40), (1 << 17) - 1, 1 << 17, 3 << 17)]
    got = [r for r in found(spark, rows) if r[1] == 0 or r[3] > 1]
    assert got == [r for r in brute(rows) if r[1] == 0 or r[3] > 1]


def test_empty_and_nothing_but_null_ids(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_null_arrays_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None), (2, []), (None, []), (3, [(b"0" * 16, 4)])], "conv_id long, turns array<struct<turn: binary, words: int>>")
    df = df.selectExpr("*", "1 as node", "2 as path", "3 as depth")
    got = sorted(tuple(r)[:7] for r in prefix_trie(df).collect())
    assert got == [(1, 0, None, 3, 1, 1, 0), (3, 1, 1, 1, 0, 1, 0)]
