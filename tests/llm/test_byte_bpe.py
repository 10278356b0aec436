"""Tree-reduced byte-level BPE against the tiktoken library, and back."""

import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from kairospark.llm.byte_bpe import _ANCHOR, Bpe, decoded, encoded
from tests.llm.conftest import prose

RANKS = path("byte_bpe_50k.tiktoken")
BPE = Bpe.load(RANKS, PATTERN)
#: What meets at boundaries: runs, contractions, white space of all kinds, letters of several scripts, characters of several bytes.
PIECES = ["a", "aa", "b", "the", " the", "'", "'s", "'ll", "l", "ve", " ", "  ", "\n", "\t", "\r\n", "　", "\x85", "\x1c", "0", "17", "!", "--", "=", "é", "ß", "漢", "字", "，", "ㄱ", "한", "😀", "́", "<|endoftext|>", "Straße", "_", "\\"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.integers(1, 40)), max_size=14), st.sampled_from([1, 2, 3, 5, 8, 33]))
@example([(" ", 200), ("x", 1)], 4)
@example([("a", 333)], 2)
@example([("!", 3), ("'", 1), ("s", 1)], 1)
@example([(" ", 37), ("\n", 5), (" ", 1), ("a", 40)], 3)
def test_any_leaf_size_gives_the_librarys_tokens(parts, leaf):
    text = "".join(p * n for p, n in parts)
    ids = BPE.encode(text, leaf)
    assert ids.tolist() == BPE.library.encode_ordinary(text)
    assert BPE.bytes_of(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120), st.sampled_from([1, 2, 7, 30]))
def test_any_text(text, leaf):
    assert BPE.encode(text, leaf).tolist() == BPE.library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_anchors_settle_both_sides(text):
    whole = BPE.library.encode_ordinary(text)
    for m in _ANCHOR.finditer(text):
        assert BPE.library.encode_ordinary(text[: m.start()]) + BPE.library.encode_ordinary(text[m.start() :]) == whole


def test_white_space_is_the_librarys():
    """Where the library's pattern sees white space, so does ours: a second space before it is a token alone or not."""
    for c in map(chr, [*range(0x21), *range(0x7F, 0x100), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]):
        assert BPE.encode(f"x  {c}y", 1).tolist() == BPE.library.encode_ordinary(f"x  {c}y"), hex(ord(c))
        assert bool(regex.match(r"\p{White_Space}", c)) == (c in "\t\n\x0b\x0c\r \x85\xa0     　" or 0x2000 <= ord(c) <= 0x200A)


def test_pairs_that_hold_are_an_encoding():
    """Random splits of a long match, joined in random order, give what merging from scratch gives."""
    rng = random.Random(4)
    for _ in range(60):
        data = "".join(rng.choice(["a", "aa", "th", "e", "in", "ß", "q"]) * rng.randint(1, 9) for _ in range(40)).encode()
        cuts = sorted(rng.sample(range(1, len(data)), 12))
        parts = [np.array(BPE.piece(data[a:b]), np.uint32) for a, b in zip([0, *cuts], [*cuts, len(data)])]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [BPE.joined(parts[k], parts[k + 1])]
        assert parts[0].tolist() == BPE.merged(data)


def test_tokens_that_merges_never_make():
    """A whole match is looked up before it is merged; inside a longer one the same bytes are merged."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257}
    own = Bpe(ranks, PATTERN)
    assert own.merged(b"abc") == [256]
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257, b"abcd": 300, b"xyz": 301, b"dx": 258}
    own = Bpe(ranks, PATTERN)
    for text in ("xyz", "xyzab", "abcdxyz", "abcd" * 9 + " xyz", "xyz" * 20):
        for leaf in (1, 2, 3, 50):
            assert own.encode(text, leaf).tolist() == own.library.encode_ordinary(text), (text, leaf)


def test_long_runs_take_few_steps():
    rng = random.Random(6)
    for text in ("a" * 100_000, " " * 50_001 + "x", "漢字" * 30_000, "-" * 70_003 + "'s" + "=" * 9, prose(rng, 30_000), "".join(rng.choice("ab") for _ in range(60_000))):
        assert BPE.encode(text).tolist() == BPE.library.encode_ordinary(text)


def expected(text):
    ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={}).encode_ordinary(text or "")
    return ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("table", ["odd", "empty"])
def test_tables(table, packed, request):
    docs = request.getfixturevalue(table)
    out = decoded(encoded(docs, RANKS, PATTERN, packed=packed, leaf=512), RANKS, PATTERN)
    assert out.columns == ["doc_id", "ids", "decoded"]
    unpack = (lambda x: np.frombuffer(x, "<u4").tolist()) if packed else list
    got = sorted((str(r.doc_id), unpack(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((str(r.doc_id), expected(r.text)[0], (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())


def test_query_on_the_smallest_tables(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    from kairospark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, digest = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
