"""What a compaction and the query on it cost: each table is read once, each compaction shuffles once."""

import os

import pytest

from kairospark import queries
from kairospark.operators import pit

SF = "/root/testdata/sf0.001"


def test_parts_merged_by_range_take_one_shuffle(spark):
    made = [pit.normalized(spark.createDataFrame(rows, "series_key string, obs_date string, asof_utc string, value double"), "2002-01-01") for rows in ([("a", "2024-01-31", "2024-02-01", 1.0), ("b", "2024-01-31", "2024-02-01", 2.0)], [("a", "2024-01-31", "2024-02-01", 3.0), ("a", "2024-01-31", "2024-02-02", None)])]
    one, two = pit.merged(*made, by_range=True), pit.merged(*made)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_compacted_reads_orders_once(spark, monkeypatch):
    read, table = [], queries.table
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    queries.pit_compacted(spark, SF)
    assert read == ["orders"]
