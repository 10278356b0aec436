"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the columns of facts (inner join), which has one row for each key and says in `count` how many of the `total` rows have it at most.

    Keys with more than one in `share` of all rows are under `share` in number, so these facts are broadcast and their rows stay where they are; all other rows are shuffled, and no key brings a task more than that share. facts is read three times: store it first if it is dear to make. Empty tables: no rows. Null keys: dropped.
    """
    often = facts.where(F.col(count) * share > total)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def with_facts(rows: DataFrame, key: str, by: str, *facts: Column, where: str | None = None, parts: int = 64) -> DataFrame:
    """rows with aggregates of all rows of their key as new columns; where: a condition on the aggregates that a key must meet.

    A key's rows are dealt over `parts` places by a hash of `by`, and the aggregates, found with map-side combining, go to those places only that the key has rows in. So no task gets more than its share of a hot key, nothing is broadcast, and as many aggregates are sent as rows at most. A null key's rows are dropped; where `by` is null they are in one place. Empty tables: no rows. rows is read twice: store it first if it is dear to make.
    """
    dealt = rows.withColumn("place", F.pmod(F.xxhash64(by), F.lit(parts)))
    known = dealt.groupBy(key).agg(*facts, F.collect_set("place").alias("place"))
    if where:
        known = known.where(where)
    return dealt.join(known.withColumn("place", F.explode("place")), [key, "place"]).drop("place")
