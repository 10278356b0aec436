"""The pipeline's stages and run() against plain code, and every registered query on the smallest tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from kairospark.llm import stages
from kairospark.llm.queries import QUERIES
from kairospark.llm.secrets import field_spans, fit_secret_model
from kairospark.llm.toxicity import fit_toxicity, terms
from tests.llm.conftest import prose
from tests.llm.test_exact import distance, edited
from tests.llm.test_secrets import simple_base

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of which some are toxic, near copies, contaminated or hold secrets, as files."""
    rng, where = random.Random(31), tmp_path_factory.mktemp("corpus")
    items = [prose(rng, rng.randint(15, 40)) for _ in range(4)]
    texts, toxic = [], []
    for k in range(260):
        base = prose(rng, rng.randint(30, 160), 6000)
        bad = k % 5 == 0
        text = base + (" you filthy vermin people" if bad else "")
        texts.append(text)
        toxic.append(int(bad))
        if k % 13 == 1:
            texts.append(edited(rng, text, 1))
            toxic.append(int(bad))
        if k % 11 == 2:
            texts[-1] += " " + edited(rng, items[k % 4], k % 3)
        if k % 17 == 3:
            texts[-1] += f' token = "{"".join(rng.choice("abcdef0123456789") for _ in range(20))}" end'
    texts += [None, "", "same words here", "same words here"]
    toxic += [0] * 4
    docs = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"file://{where}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"file://{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{where}/benchmark.parquet")
    return f"file://{where}", texts, items


def plain_classes(texts):
    """Class of each text, by all pairs of multisets of five words; equal words are copies."""
    words = [(t or "").split() for t in texts]
    bags = [Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if words[i] == words[j] or both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_each_stage_by_plain_code(spark, corpus):
    where, texts, items = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")

    m = fit_toxicity(docs, labels)
    kept = {r.doc_id for r in stages.drop_toxic(spark, docs, where).collect()}
    row, term = terms(pa.array(texts))
    for k in range(len(texts)):
        rows = m.row_of[term[row == k]]
        rows = rows[rows >= 0]
        pairs = sum(float(m.v[i] @ m.v[j]) for a, i in enumerate(rows) for j in rows[a + 1 :]) if len(rows) < 200 else None
        if pairs is not None and abs(logit := m.bias + m.w[rows].sum() + pairs) > 1e-6:
            assert (k in kept) == (logit < 0)
    assert 150 < len(kept) < len(texts) - 20

    classes = plain_classes(texts)
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, where).collect()} == set(classes)

    word = lambda s: re.findall(r"[a-z0-9]+", (s or "").lower())
    clean = {k for k, t in enumerate(texts) if not any(distance(word(i), word(t)) <= int(0.2 * len(word(i))) for i in items)}
    assert {r.doc_id for r in stages.drop_contaminated(spark, docs, where).collect()} == clean and len(clean) < len(texts) - 10

    model = fit_secret_model(docs)
    masked = {r.doc_id: r for r in stages.mask_secrets(spark, docs, where).collect()}
    found = field_spans(pa.array(texts), model)
    for k, t in enumerate(texts):
        spans, out, at = sorted([(a, b) for a, _, b in simple_base(t or "")] + found.get(k, [])), [], 0
        for a, b in spans:
            if b > at:
                if a >= at:
                    out += [t[at:a], "[SECRET]"]
                at = b
        assert masked[k].text == ("".join([*out, t[at:]]) if spans else t)
        assert masked[k].n_chars == (None if t is None else len(masked[k].text))
    assert sum("[SECRET]" in (r.text or "") for r in masked.values()) >= 10

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    held, used = Counter(), Counter()
    for r in stages.pack_documents(spark, docs, where).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        held[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert sum(held.values()) == sum(used.values()) and len(held) == len(texts) and max(used.values()) <= 2048


def test_run_is_the_stages_one_after_the_other(spark, corpus):
    where, texts, _ = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, where).select(columns).collect()
        assert len(rows) < before or name == "secrets"
        before, docs = len(rows), spark.createDataFrame(rows, COLUMNS)
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in packed} == left
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_registered_queries_on_the_smallest_tables(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    run = lambda name: QUERIES[name](spark, SF).collect()

    word = lambda s: re.findall("[" + "".join(map(re.escape, "abcdefghijklmnopqrstuvwxyz0123456789")) + "\x80-\U0010ffff]+", s.lower())
    words = {i: word(t) for i, t in items.items()}
    got = {(r.doc_id, r.item_id) for r in run("op1_decontaminate")}
    for d, i in got:
        assert distance(words[i], word(rows[d])) <= int(0.2 * len(words[i]))
    assert {(d, i) for d, t in rows.items() for i, w in words.items() if " ".join(w) in " ".join(word(t))} <= got

    for name in ("op3_toxicity", "op4_quality"):
        own = run(name)
        assert sorted(r.doc_id for r in own) == sorted(rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if "3" in name else 0.3)) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in own)

    ids = sorted(rows)
    classes = plain_classes([rows[k] for k in ids])
    assert {r.doc_id: r.class_id for r in run("op5_near_duplicates")} == {k: ids[classes[n]] for n, k in enumerate(ids)}

    tokenizer, held = Tokenizer.from_file(path("word_bpe_49k.json")), Counter()
    for r in run("op8_packing"):
        own = np.array([*tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(own), zlib.crc32(own[r.start : r.start + r.length].tobytes()))
        held[r.doc_id] += r.length
    assert set(held) == set(rows)

    for r in run("op9_secret_scan"):
        base = simple_base(rows[r.doc_id])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) - {""} <= set(r.spans.split(","))

    counts = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for r in run("op10_token_counts"):
        n = len(counts.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 512)
