"""The two classifiers against plain sums, and what a pair says that its members don't."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from kairospark.llm import quality, toxicity
from kairospark.llm.toxicity import FactorizationMachine, fit_machine
from tests.llm.conftest import prose


def numbered(rng, n, vocabulary=300):
    return [prose(rng, rng.randint(0, 60), vocabulary) for _ in range(n)]


def test_the_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = FactorizationMachine(0.3, np.where(np.arange(1 << toxicity.BITS) % 3 == 0, np.arange(1 << toxicity.BITS) // 3, -1), rng.normal(0, 0.3, (1 << toxicity.BITS) // 3 + 1), rng.normal(0, 0.2, ((1 << toxicity.BITS) // 3 + 1, 4)))
    texts = [*numbered(random.Random(2), 12), "", None]
    row, term = toxicity.terms(pa.array(texts))
    got = m.score(row, term, len(texts))
    for k in range(len(texts)):
        own = sorted({int(t) for r, t in zip(row, term) if r == k and m.row_of[t] >= 0})
        rows = m.row_of[own]
        logit = m.bias + sum(m.w[i] for i in rows) + sum(m.v[i] @ m.v[j] for a, i in enumerate(rows) for j in rows[a + 1 :])
        assert abs(got[k] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_terms_are_words_and_their_heads():
    row, term = toxicity.terms(pa.array(["One considerable, ONE", "x", ""]))
    assert np.bincount(row, minlength=3).tolist() == [6, 1, 0]  # one, considerable, and four heads of it
    assert set(term[row == 0]) >= set(toxicity.terms(pa.array(["one"]))[1])


def test_a_pair_says_what_its_members_do_not():
    # Either word alone is toxic, both or none isn't, and each is as frequent in either kind of text.
    rng = random.Random(3)
    texts, y = [], []
    for _ in range(3300):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(prose(rng, 25, 200) + (" fool" if a else "") + (" tribe" if b else ""))
        y.append(float(a != b))
    row, term = toxicity.terms(pa.array(texts))
    rows, y = np.split(term, np.searchsorted(row, np.arange(1, len(texts)))), np.array(y)
    m = fit_machine(rows[:3000], y[:3000])
    doc = np.repeat(np.arange(300), [len(r) for r in rows[3000:]])
    right = lambda m: ((m.score(doc, np.concatenate(rows[3000:]), 300) >= 0.5) == (y[3000:] > 0)).mean()
    flat = FactorizationMachine(m.bias, m.row_of, m.w, 0 * m.v)
    assert right(m) > 0.95 and right(flat) < 0.7
    assert right(fit_machine(rows[:3000], y[:3000], most_terms=20, common_terms=0)) < 0.7  # chosen by what they say alone, the words are left out


def plain_tokens(text):
    """Runs of letters, digits and bytes above ASCII, and runs of other marks."""
    out, kind = [], None
    for byte in (text or "").encode():
        now = " " if byte == 0x20 or 9 <= byte <= 13 else "a" if byte >= 0x80 or chr(byte).isalnum() else "!"
        if now != " ":
            if now == kind:
                out[-1].append(byte)
            else:
                out.append([byte])
        kind = now
    return [bytes(x).decode() for x in out]


def bucket(word):
    return int(quality.token_stream(pa.array([word]))[0][0])


def test_context_sums_and_pooling_by_plain_code(make):
    texts = [*numbered(random.Random(4), 40, 60), None, "", "Ünï!! cödé ... x", "one"]
    place, sign = quality._index_vectors()
    want = defaultdict(lambda: np.zeros(quality.WIDTH))
    for t in texts:
        b = [bucket(w) for w in plain_tokens(t)]
        for i, x in enumerate(b):
            for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)):
                if i != j:
                    for p, s in zip(place[b[j]], sign[b[j]]):
                        want[x][p] += s
    for salts in (1, 5):
        got = quality.contexts(make(texts), salts)
        assert all((got[x] == v).all() for x, v in want.items())
        assert not np.delete(got, list(want), axis=0).any()
    vectors = quality.word_vectors(got)
    pooled = quality.pooled(pa.array(texts), vectors)
    for k, t in enumerate(texts):
        own = np.array([vectors[bucket(w)] for w in plain_tokens(t)], float)
        assert np.allclose(pooled[k], np.concatenate([own.mean(0), own.std(0)]) if len(own) else 0, atol=1e-3)


def test_a_long_text_is_pooled_in_chunks(monkeypatch):
    texts = [prose(random.Random(5), 900), "a b", None, prose(random.Random(6), 50)]
    vectors = np.random.default_rng(1).normal(size=(1 << quality.BITS, quality.WIDTH)).astype(np.float32)
    want = quality.pooled(pa.array(texts), vectors)
    monkeypatch.setattr(quality, "_CHUNK", 7)
    assert np.allclose(quality.pooled(pa.array(texts), vectors), want, atol=1e-4)


def test_the_network_by_plain_code():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2 * quality.WIDTH))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    m = quality.fit_network(x, y, np.zeros((1, 1)), steps=60)
    w1, b1, w2, b2 = m.layers
    for k in range(5):
        hidden = [max(0.0, sum((x[k, i] - m.shift[i]) / m.scale[i] * w1[i, j] for i in range(x.shape[1])) + b1[j]) for j in range(len(b1))]
        logit = (sum(h * w2[j, 0] for j, h in enumerate(hidden)) + b2[0]) / m.temperature
        assert abs(m.score(x[k : k + 1])[0] - 1 / (1 + np.exp(-logit))) < 1e-9
