"""The canonical panel: ts_utc (naive UTC), entity_id (string) and value columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairospark.functions.times import at, known, to_utc

KEYS = ("ts_utc", "entity_id")


def from_long(df: DataFrame, time_col: str = "date", entity_col: str = "entity_id") -> DataFrame:
    """A long table with canonical keys first; NaN becomes NULL. Raises ValueError without a key column."""
    if lacking := [c for c in (time_col, entity_col) if c not in df.columns]:
        raise ValueError(f"missing columns: {lacking}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (time_col, entity_col)]
    return known(df.select(to_utc(df, time_col).alias("ts_utc"), F.col(f"`{entity_col}`").cast("string").alias("entity_id"), *rest))


def entity_frame(spark: SparkSession, entities: Any) -> DataFrame:
    """entity_id, from a list of names, which is small, or from a DataFrame with that column, which can grow: each name once, NULL is none."""
    if isinstance(entities, DataFrame):
        return entities.select(F.col("entity_id").cast("string").alias("entity_id")).where(F.col("entity_id").isNotNull()).distinct()
    return F.broadcast(spark.createDataFrame([(str(e),) for e in entities], "entity_id string"))


def sliced(panel: DataFrame, start: Any = None, end: Any = None, entities: Sequence[Any] | DataFrame | None = None) -> DataFrame:
    """Both time bounds included. Entities in a DataFrame are kept by a semi-join."""
    if start is not None:
        panel = panel.where(F.col("ts_utc") >= at(start))
    if end is not None:
        panel = panel.where(F.col("ts_utc") <= at(end))
    if isinstance(entities, DataFrame):
        members = entity_frame(panel.sparkSession, entities).withColumnRenamed("entity_id", "member")
        return panel.join(members, panel["entity_id"] == members["member"], "left_semi")
    return panel if entities is None else panel.where(F.col("entity_id").isin([str(e) for e in entities]))


def ordered(panel: DataFrame) -> DataFrame:
    """Sorted for presentation; nothing else here depends on order."""
    return panel.orderBy(*KEYS)


def repeated_keys(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The keys that occur more than once."""
    return panel.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The panel, or ValueError if a key repeats. One aggregate job."""
    if (found := repeated_keys(panel, keys).limit(1).collect()) :
        raise ValueError(f"repeated key {tuple(found[0])[:-1]}")
    return panel


def unique_in_plan(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The panel, whose rows can't be read if a key repeats: the job that reads them fails with that key. No job of its own: keys are counted in a window by them, whose shuffle and order a join on the same keys uses again."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fault = F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys)))).cast("boolean")
    return panel.withColumn("__n", n).where(F.when(F.col("__n") > 1, fault).otherwise(F.lit(True))).drop("__n")
