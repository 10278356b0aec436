"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairospark.llm.columns import thin_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The conversation that op2 formats beside the table's own: its text looks like marks.
MARKED = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    thin_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def registered(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@registered
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.chat_format import chat_digest, chat_examples

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    return chat_digest(chat_examples(turns.unionByName(marked)))


ORACLES["op2_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    2 * length(role) - length(regexp_replace(role, '[\\<>]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\<>]', '', 'g')) + 16 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""


@registered
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@registered
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@registered
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLES["op6_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


@registered
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


ORACLES["op7_substring_dedup"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM t),
s AS (SELECT r, unnest(range(1, len(words) - 33)) AS k, words FROM t WHERE len(words) >= 35),
h AS (SELECT r, k, array_to_string(words[k:k + 34], ' ') AS run FROM s),
again AS (SELECT r, k, count(*) OVER (PARTITION BY run) > 1 AS repeated FROM h),
m AS (SELECT w.r, w.k, w.word, coalesce(bool_or(again.repeated) OVER (PARTITION BY w.r ORDER BY w.k ROWS 34 PRECEDING), false) AS gone FROM w LEFT JOIN again ON again.r = w.r AND again.k = w.k),
o AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN o ON o.r = t.r"""


@registered
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@registered
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.secrets import fit_secret_model, secret_spans

    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, fit_secret_model(docs))


@registered
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@registered
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kairospark.llm.byte_bpe import decoded, encoded

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    there_and_back = decoded(encoded(table(spark, sf_dir, "documents"), ranks, pattern, packed=True), ranks, pattern)
    return there_and_back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.prefix_trie import prefix_trie, turn_arrays, with_shared_heads

    return prefix_trie(with_shared_heads(turn_arrays(table(spark, sf_dir, "conversations"))))


# DuckDB has no crc32: it is taken from a table of the 256 bytes, which the polynomial gives.
ORACLES["op12_prefix_trie"] = r"""
WITH RECURSIVE b(n, v, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM b WHERE k < 8),
bytes AS (SELECT list(v ORDER BY n) AS t FROM b WHERE k = 8),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
digits(conv_id, v, rest) AS (
  SELECT conv_id, 4294967295, conv_id::VARCHAR FROM ids UNION ALL
  SELECT conv_id, xor((SELECT t FROM bytes)[xor(v & 255, ascii(rest)) + 1], v >> 8), substr(rest, 2) FROM digits WHERE rest <> ''),
h AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM digits WHERE rest = ''),
built AS (
  SELECT h.conv_id, 0 AS part, t.k, t.role, t.text FROM h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h
  UNION ALL SELECT h.conv_id, 1, t.k, t.role, t.text FROM h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
member AS (SELECT conv_id, depth, node, words, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM placed UNION ALL SELECT conv_id, 0, '', 0, NULL FROM ids),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n, min(conv_id) AS conv_id FROM member GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
pairs AS (SELECT DISTINCT a.node AS top, d.node FROM member a JOIN member d ON a.conv_id = d.conv_id AND d.depth >= a.depth),
below AS (SELECT top AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n - 1) * n.words)::BIGINT AS saved_tokens FROM pairs JOIN nodes n USING (node) LEFT JOIN kids k ON k.node = n.node GROUP BY top),
last AS (SELECT conv_id, max_by(node, depth) AS node FROM member GROUP BY conv_id),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node"""


@registered
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kairospark.llm.filter_audit import filter_audit, mask_counts

    return filter_audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE p(o, s) AS (SELECT '', 0 UNION ALL SELECT o || f, s + 1 FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE s < 5 AND NOT contains(o, f)),
steps AS (SELECT o AS filter_order, unnest(range(1, 6))::INTEGER AS step FROM p WHERE s = 5),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM d GROUP BY ALL),
x AS (
  SELECT part, good, toxic, fails, n, filter_order, step, substr(filter_order, step, 1) AS f, contains(fails, substr(filter_order, step, 1)) AS hit,
    len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS earlier
  FROM c, steps),
r AS (
  SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE hit AND NOT earlier AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE hit AND NOT earlier AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
