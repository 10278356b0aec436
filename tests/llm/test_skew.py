"""The joins for hot keys against plain ones."""

from pyspark.sql import functions as F

from kairospark.llm.skew import joined, with_facts


def test_hot_and_rare_keys_join_alike(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700 + 1).alias("key"))
    facts = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for share in (10, 1000):
        got = joined(rows, facts, "key", "n", 3000, share).select("id", "key", "n", "top")
        assert sorted(got.collect()) == sorted(rows.join(facts, "key").select("id", "key", "n", "top").collect())


def test_no_rows(spark):
    rows, facts = spark.createDataFrame([], "id long, key long"), spark.createDataFrame([], "key long, n long")
    assert joined(rows, facts, "key", "n", 0).count() == 0


def test_facts_of_a_key_reach_all_its_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700 + 1).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("by"))
    facts = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for parts, where in ((1, None), (16, None), (64, "n > 3")):
        got = with_facts(rows, "key", "by", F.count("*").alias("n"), F.max("id").alias("top"), where=where, parts=parts)
        assert got.columns == ["key", "id", "by", "n", "top"]
        plain = rows.join(facts.where(where or "true"), "key").select("id", "n", "top")
        assert sorted(got.select("id", "n", "top").collect()) == sorted(plain.collect())
    assert with_facts(rows.limit(0), "key", "by", F.count("*").alias("n")).count() == 0


def test_no_task_of_the_join_gets_a_hot_key_whole(spark):
    rows = spark.range(64_000).select(F.lit(1).alias("key"), "id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "64"), strict=True):
            spark.conf.set(k, v)
        met = with_facts(rows, "key", "id", F.count("*").alias("n"))
        held = met.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held[1] == 64_000 and held[0] < 8_000
