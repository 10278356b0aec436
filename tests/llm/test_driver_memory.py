"""What the driver holds while it fits models and while near duplicates are found."""

import random
import tracemalloc

import numpy as np

from kairospark.llm import near_dup
from kairospark.llm.secrets import N_FEATURES, _SIZES, fit_crf
from kairospark.llm.toxicity import fit_machine


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_field_holds_its_sequences_once_and_in_two_bytes_a_feature():
    rng = np.random.default_rng(1)
    features = 11 * len(_SIZES)

    def fitted(n):
        rows = [rng.integers(0, N_FEATURES, (11, len(_SIZES))).astype(np.int16) for _ in range(n)]
        return peak(lambda: fit_crf(rows, [np.zeros(11, np.int8)] * n, steps=1))

    assert fitted(12_000) - fitted(4_000) < 8_000 * features * 2.5  # 8 bytes a feature before


def test_the_machine_counts_terms_without_all_of_them_at_once():
    rng = np.random.default_rng(1)

    def fitted(n):
        rows, y = [rng.choice(1 << 18, 2_000, replace=False).astype(np.int32) for _ in range(n)], np.arange(n) % 2.0
        return peak(lambda: fit_machine(rows, y, most_terms=8, common_terms=8, steps=1))

    assert fitted(2_000) - fitted(1_000) < 1_000 * 2_000 * 2  # over 8 bytes a term before


def test_near_duplicates_run_small_plans_alone(make, monkeypatch):
    """Links, groups that no leader settles and copies; no step makes again what another has made."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    near = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(4000)}" for w in base) for _ in range(60)]
    docs = make([*near, *near[:5], "one", None, *(" ".join(f"y{rng.randrange(4000)}" for _ in range(60)) for _ in range(20))])
    exchanges, kept = [], near_dup.stored

    def stored(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return kept(df)

    monkeypatch.setattr(near_dup, "stored", stored)
    result = near_dup.near_duplicates(docs)
    exchanges.append(result._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert result.count() == docs.count()
    assert max(exchanges) <= 9, exchanges
