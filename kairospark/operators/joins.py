"""Key-aligned joins, as-of joins, and the grid of times and entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairospark.operators.panel import KEYS


def grid_by_entities(grid: DataFrame, entities: DataFrame) -> DataFrame:
    """Every time of the grid for every entity: the result itself has that many rows."""
    return grid.select("ts_utc").crossJoin(entities.select("entity_id"))


def join_frames(frames: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    """Frames with the same keys side by side; inner keeps common keys, outer all. All joins are on the same keys, so each frame is shuffled once."""
    if not frames:
        raise ValueError("no frames to join")
    if how not in ("inner", "outer"):
        raise ValueError(f"unknown join {how!r}")
    names = [c for f in frames for c in f.columns if c not in KEYS]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated feature names: {sorted({n for n in names if names.count(n) > 1})}")
    return reduce(lambda a, b: a.join(b, list(KEYS), "full" if how == "outer" else "inner"), frames)


def first_catalog(catalogs: Sequence[DataFrame]) -> DataFrame:
    """Catalogs one after the other, each feature once: its first entry."""
    numbered = [c.withColumn("__frame", F.lit(k)).withColumn("__row", F.monotonically_increasing_id()) for k, c in enumerate(catalogs)]
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy("__frame", "__row"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered).withColumn("__n", rank).where("__n = 1").drop("__n", "__frame", "__row")


def next_in_grid(rows: DataFrame, grid: DataFrame, time: str = "ts_utc") -> DataFrame:
    """Each row with target_end: the first grid time after its own, NULL after the last or without a time.

    Grid times are gathered by day into short arrays, and each row looks into its day's array, else takes the first time of a later day. The table of days has a row for each distinct day and one window; rows are joined to it by day, without a sort over all of them.
    """
    day = F.col(time).cast("date")
    ticks = grid.select(F.col("ts_utc").alias("__g")).distinct().groupBy(F.col("__g").cast("date").alias("__d")).agg(F.sort_array(F.collect_list("__g")).alias("__ticks"))
    days = rows.select(day.alias("__day")).where("__day IS NOT NULL").distinct()
    both = days.select(F.col("__day"), F.lit(None).cast("timestamp_ntz").alias("__first")).unionByName(ticks.select(F.col("__d").alias("__day"), F.get("__ticks", F.lit(0)).alias("__first"))).groupBy("__day").agg(F.min("__first").alias("__first"))
    after = Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct day
    later = both.select("__day", F.last("__first", ignorenulls=True).over(after).alias("__later"))
    table = later.join(ticks.withColumnRenamed("__d", "__day"), "__day", "left")
    found = F.get(F.filter("__ticks", lambda x: x > F.col("__t")), F.lit(0))
    own = rows.withColumns({"__day": day, "__t": F.col(time)})
    return own.join(table, "__day", "left").withColumn("target_end", F.coalesce(found, "__later")).drop("__day", "__t", "__ticks", "__later")
