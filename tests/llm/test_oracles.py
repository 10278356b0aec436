"""The queries of this subpackage that have a DuckDB form against it, on the smallest tables."""

import os

import duckdb
import pytest

from kairospark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(ORACLES[name])
    got = QUERIES[name](spark, SF).select([d[0] for d in want.description])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
