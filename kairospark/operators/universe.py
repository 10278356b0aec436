"""Time-varying membership."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairospark.functions.times import at
from kairospark.operators.scans import segment_of


def from_wide(wide: DataFrame, date_col: str = "date") -> DataFrame:
    """(date, entity_id, is_member) from one boolean column for each entity; NULL is no member."""
    entities = [c for c in wide.columns if c != date_col]
    return wide.unpivot([date_col], entities, "entity_id", "is_member").select(F.col(date_col).cast("timestamp_ntz").alias("date"), "entity_id", F.coalesce(F.col("is_member").cast("boolean"), F.lit(False)).alias("is_member"))


def entities_on(universe: DataFrame, date) -> DataFrame:
    """Members on the date: by the matrix row of that date, else the latest before, else none."""
    last = universe.where(F.col("date") <= at(date)).agg(F.max("date").alias("date"))
    return universe.join(F.broadcast(last), "date").where("is_member").select("entity_id")


def spells(universe: DataFrame) -> DataFrame:
    """(entity_id, since, until) of each longest stretch of matrix rows with membership; until is excluded, NULL is open. A matrix row holds for all entities until the next one: an entity without an entry in it is no member from then on. There are as many rows as membership changes, however many dates the matrix has."""
    w = Window.orderBy("date")
    rows = universe.select("date").distinct().select("date", F.row_number().over(w).alias("i"), F.lead("date").over(w).alias("until"))
    members = universe.where("is_member").select("date", "entity_id").distinct().join(rows, "date")
    run = F.col("i") - F.row_number().over(Window.partitionBy("entity_id").orderBy("i"))
    return members.withColumn("run", run).groupBy("entity_id", "run").agg(F.min("date").alias("since"), F.max_by("until", "i").alias("until")).drop("run")


#: Ranges that rows after the last matrix row are dealt over.
_AFTER = 64


def restricted(panel: DataFrame, universe: DataFrame, segment: timedelta | None = None) -> DataFrame:
    """The rows whose entity is a member as of their time. An equi-join on the entity with a range condition; Spark broadcasts the spells where they are small.

    With a segment, spells are cut at ranges of time of that length and joined by entity and range, so that no task has all rows of a hot entity. A spell has a row for each range that it covers; what lies after the last matrix row, where membership doesn't change, is dealt over 64 places by range.
    """
    s = spells(universe).withColumnRenamed("entity_id", "member")
    within = (panel["entity_id"] == s["member"]) & (panel["ts_utc"] >= s["since"]) & (s["until"].isNull() | (panel["ts_utc"] < s["until"]))
    if segment is None:
        return panel.join(s, within, "left_semi")
    last = F.broadcast(universe.agg((segment_of(F.max("date"), segment) + 1).alias("__end")))
    place = lambda n: F.when(n < F.col("__end"), n).otherwise(F.col("__end") + F.pmod(n, F.lit(_AFTER)))
    until = F.when(F.col("until").isNull(), F.col("__end") + (_AFTER - 1)).otherwise(segment_of(F.col("until"), segment))
    cut = s.crossJoin(last).withColumn("__in", F.explode(F.sequence(segment_of(F.col("since"), segment), until))).drop("__end")
    rows = panel.crossJoin(last).withColumn("__at", place(segment_of(F.col("ts_utc"), segment))).drop("__end")
    within = (rows["entity_id"] == cut["member"]) & (rows["__at"] == cut["__in"]) & (rows["ts_utc"] >= cut["since"]) & (cut["until"].isNull() | (rows["ts_utc"] < cut["until"]))
    return rows.join(cut, within, "left_semi").drop("__at")
