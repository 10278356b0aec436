"""Families of near copies without their original: every link, by work that grows no faster than the family."""

import random

import numpy as np
import pytest

from kairospark.llm import near_dup


def family(m, words=200, edits=4, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for k in range(m):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"new{k}x{at}"
        out.append(" ".join(own))
    return out


def classes(texts, least=0.8):
    """Class of each text by brute force over all pairs. Words don't repeat within a shingle's place here, so sets do for multisets."""
    seen: dict = {}
    rows = []
    for t in texts:
        w = t.split()
        rows.append([seen.setdefault(tuple(w[s : s + 5]), len(seen)) for s in range(len(w) - 4)])
    count = np.bincount(np.concatenate(rows))
    often = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    x = np.zeros((len(texts), len(often)), np.float32)
    for k, r in enumerate(rows):
        own = place[r]
        x[k, own[own >= 0]] = 1
    size = np.array([len(r) for r in rows])
    common = x @ x.T
    like = common >= least * (size[:, None] + size[None, :] - common)
    root = np.arange(len(texts))
    for i, j in zip(*np.nonzero(np.triu(like, 1))):
        a, b = root[i], root[j]
        if a != b:
            root[root == max(a, b)] = min(a, b)
    return root, int(np.triu(like, 1).sum())


def test_rows_compared_grow_with_the_family_and_no_link_is_lost(make, monkeypatch):
    rows = {}
    within = near_dup._within
    for m in (500, 1000, 2000):
        texts = family(m, seed=m)
        seen = []
        monkeypatch.setattr(near_dup, "_within", lambda groups, least, seen=seen: (seen.append(groups.count()), within(groups, least))[1])
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(make(texts)).collect()}
        want, links = classes(texts)
        assert got == dict(enumerate(want.tolist()))
        rows[m] = (sum(seen), links)
    assert rows[2000][1] > 0  # there are links to lose
    assert rows[2000][0] < 2.2 * rows[1000][0] and rows[1000][0] < 2.2 * rows[500][0]


@pytest.mark.parametrize("block", [16, 40])
def test_refined_groups_hold_all_links(make, block):
    texts = []
    for seed, (m, edits) in enumerate(((60, 4), (40, 2), (30, 1), (25, 6))):
        texts += family(m, 120, edits, seed)
    random.Random(3).shuffle(texts)
    want, _ = classes(texts)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(make(texts), block=block, elements=50_000).collect()}
    assert got == dict(enumerate(want.tolist()))
