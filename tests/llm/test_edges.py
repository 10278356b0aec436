"""Every operator on null, empty, very long and repeated rows, on empty tables, and with clashing columns."""

import pytest
from public_tokenizers import path

from kairospark.llm import stages
from kairospark.llm.decontaminate import contaminated, decontaminated
from kairospark.llm.near_dup import near_duplicates
from kairospark.llm.packing import pack
from kairospark.llm.quality import fit_quality, quality_scores
from kairospark.llm.secrets import fit_secret_model, secret_spans, without_secrets
from kairospark.llm.substrings import without_repeats
from kairospark.llm.token_counts import token_counts
from kairospark.llm.topk import top_k
from kairospark.llm.toxicity import fit_toxicity, toxicity_scores, without_toxic

WORDS = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "one two"), (3, "these eight words are not in any text")], "item_id long, text string")


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_one_row_each(table, request, labels, spark):
    docs = request.getfixturevalue(table)
    n = docs.count()
    assert toxicity_scores(docs, fit_toxicity(docs, labels)).where("score between 0 and 1").count() == n
    assert quality_scores(docs, fit_quality(docs, labels)).where("score between 0 and 1").count() == n
    assert secret_spans(docs, fit_secret_model(docs)).where("spans is not null").count() == n
    assert token_counts(docs, path("byte_bpe_50k.json")).where("n_tokens >= 0").count() == n
    assert without_repeats(docs).where("n_removed <= n_words").count() == n
    assert near_duplicates(docs).count() == n


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_rows_pass_through(table, request, labels, items, spark):
    docs = request.getfixturevalue(table)
    model = fit_secret_model(docs)
    for kept in (without_toxic(docs, fit_toxicity(docs, labels.limit(0))), decontaminated(docs, items, least=3), without_secrets(docs, model)):
        assert kept.columns == docs.columns
        assert kept.count() == docs.count()
    assert contaminated(docs, items, least=3).count() == 0
    # Items of any length match: "one two" is in one text, and goes with it.
    found = [(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in contaminated(docs, items).collect()]
    assert found == ([(4, 2, 0, 0, 7)] if table == "odd" else [])
    assert decontaminated(docs, items).count() == docs.count() - len(found)
    assert contaminated(docs, items.limit(0)).count() == 0


def test_no_labels(odd, labels):
    scores = toxicity_scores(odd, fit_toxicity(odd, labels.limit(0))).collect()
    assert {r.predicted for r in scores} == {0}
    assert {r.score for r in quality_scores(odd, fit_quality(odd, labels.limit(0))).collect()} == {0.5}


def test_empty_text_has_a_class_of_its_own(odd):
    got = near_duplicates(odd).collect()
    blank = [r for r in got if r.doc_id in (0, 1, 2)]
    assert {r.class_id for r in blank} == {0} and all(r.copies == 4 for r in blank)
    assert {r.class_id for r in got if r.doc_id == 5} == {5}
    assert sum(r.class_id == 5 for r in got) == 4


def test_stage_keeps_one_of_each_group(spark, odd):
    kept = stages.drop_near_duplicates(spark, odd, "").collect()
    assert len([r for r in kept if r.text is None or not r.text.strip()]) == 1
    assert len([r for r in kept if r.doc_id == 5]) == 1 and not [r for r in kept if r.doc_id is None]
    assert kept[0].__fields__ == odd.columns


def test_packing_counts_all_tokens(odd, empty):
    assert pack(empty, WORDS).count() == 0
    rows = pack(odd, WORDS).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank int, score long"
    nan = float("nan")
    rows = [(0, [0.5, -0.5]), (1, None), (2, [0.1, None]), (3, [nan, 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (0, [0.4, 0.4])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 0")).collect()}
    # The smaller of the repeated query's vectors asks; ties go to the smaller id.
    assert got == {(0, 1): (6, 409 * 1024), (0, 2): (7, 409 * 1024)}
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_a_query_id_with_an_unusable_row_still_asks(spark):
    nan = float("nan")
    rows = [(0, []), (0, [0.5, 0.5]), (100, [None, 1.0]), (100, [0.5, 0.25]), (200, [-float("inf"), 0.0]), (200, [0.25, 0.5]), (300, [nan, 1.0]), (300, None), (400, []), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.query_id: r.score for r in top_k(df, df.where("vec_id % 100 = 0")).where("vec_id = 1").collect()}
    assert got == {0: 512 * 1024, 100: 512 * 1024, 200: 256 * 1024}
