"""The audit of filter orders against plain counting, and on odd tables."""

import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest

from kairospark.llm.filter_audit import FILTERS, filter_audit, lehmer_rank, mask_counts, mask_intervals
from tests.llm.conftest import prose

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = defaultdict(list)
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        fails[part or ""].append(({k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part, rows in fails.items():
        total = Counter()
        for order in map("".join, permutations(FILTERS)):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in rows if f in x[0] and not x[0] & before]
                total[f] += len(gone)
                out[part, order, step] = [sum(not x[0] & (before | {f}) for x in rows), len(gone), sum(f in x[0] and bool(x[0] & before) for x in rows), sum(x[0] == {f} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def got(docs, labels):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS[3:]] for r in filter_audit(mask_counts(docs, labels)).collect()}


def test_ranks_are_lexicographic():
    for k in range(1, 6):
        every = list(permutations(range(k)))
        for size in range(k + 1):
            for prefix in permutations(range(k), size):
                low = lehmer_rank(prefix, k)
                assert all(p[:size] == prefix for p in every[low : low + factorial(k - size)])


def test_a_mask_is_kept_or_fails_once_in_every_order():
    """At each order and step a document is kept, removed here, failing here too, or removed earlier and passing here."""
    seen = Counter()
    for mask, step, low, high, kept, removed, redundant in mask_intervals(3):
        assert kept + removed + redundant == 1
        for rank in range(low, high):
            seen[mask, step, rank] += 1
            seen["removed", mask, rank] += removed
    assert max(seen.values()) == 1
    assert all(seen["removed", mask, rank] == (mask > 0) for mask in range(8) for rank in range(6))


def test_against_plain_counting(spark):
    import random

    rng = random.Random(5)
    texts = [prose(rng, rng.choice([5, 120]), rng.choice([30, 4000])) for _ in range(25)]
    texts += [t.upper() for t in texts[:8]] + [t + " 50%" for t in texts[:10]] + [None, "", " \n", "é" * 400]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(300)]
    docs += docs[:9]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    found, want = got(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), brute(docs, labels)
    assert found == want


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_tables(table, request, labels):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    known = [tuple(r) for r in labels.collect()]
    assert got(docs, labels) == brute(rows, known)
    assert len(got(docs, labels.limit(0))) == (600 if rows else 0)


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 0, 0, 7), ("p", 3, 1, 0, 2), ("p", 2, 0, 1, 5)], "part string, mask int, good int, toxic int, n long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit(counts, "XY").collect()}
    assert rows == {("XY", 1): (12, 2, 0, 2), ("XY", 2): (7, 5, 2, 12), ("YX", 1): (7, 7, 0, 12), ("YX", 2): (7, 0, 2, 2)}
