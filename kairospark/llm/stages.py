"""The stages of the corpus pipeline. Each works on all that the one before it kept and, but for the last, returns the columns of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairospark.llm.decontaminate import decontaminated
from kairospark.llm.near_dup import near_duplicates
from kairospark.llm.packing import pack
from kairospark.llm.queries import table, vocabulary
from kairospark.llm.secrets import fit_secret_model, without_secrets
from kairospark.llm.toxicity import fit_toxicity, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts have the score of no terms and stay, unless the model calls that toxic; repeated rows are judged alike; an empty table stays empty."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays. Rows are told apart by id and text, so clashing or null ids lose nothing, and a null id counts as the largest; of rows equal in both one stays."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    classes = near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    gone = classes.where("key != class_id").select("key").distinct()
    whole = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # so no column's name can clash
    kept = whole.join(gone, "key", "left_anti")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item within its error budget go. Null and empty texts hold none and stay; repeated rows are judged alike; an empty table, or an empty benchmark, changes nothing."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay, null and empty texts, ids and repeated rows as they are."""
    return without_secrets(docs, fit_secret_model(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048. A null or empty text is its closing token alone; an empty table has no sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))
