"""Trading calendars: Monday to Friday sessions, 09:30 to 16:00 local time, no holidays."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairospark.functions.times import at, interval, utc

OPENS, CLOSES = timedelta(hours=9, minutes=30), timedelta(hours=16)


@dataclass(frozen=True)
class TradingCalendar:
    """compat: places a session by the local day on which its UTC-midnight label falls, and counts hours from that day's midnight as elapsed time; west of UTC that is the day before. Otherwise a session is on its label's date at local clock time."""

    name: str = "XNYS"
    tz: str = "America/New_York"
    compat: bool = False

    def sessions(self, spark: SparkSession, start: Any, end: Any) -> DataFrame:
        """session: the midnights of all business days from start's to end's, both included."""
        first, last = utc(start), utc(end)
        if first.date() > last.date():
            return spark.range(0).select(at(None).alias("session"))
        days = spark.range(1).select(F.explode(F.sequence(F.lit(first.date()), F.lit(last.date()))).alias("d"))
        return days.where(F.weekday("d") < 5).select(F.col("d").cast("timestamp_ntz").alias("session"))

    def _local(self, label: Column, hours: timedelta) -> Column:
        if self.compat:
            midnight = F.convert_timezone(F.lit("UTC"), F.lit(self.tz), label).cast("date").cast("timestamp_ntz")
            return F.convert_timezone(F.lit(self.tz), F.lit("UTC"), midnight) + interval(hours)
        return F.convert_timezone(F.lit(self.tz), F.lit("UTC"), label.cast("date").cast("timestamp_ntz") + interval(hours))

    def open(self, label: Column) -> Column:
        return self._local(label, OPENS)

    def close(self, label: Column) -> Column:
        return self._local(label, CLOSES)

    @staticmethod
    def next_session(ts: Column) -> Column:
        """The next business day at the same time of day."""
        return ts + F.make_dt_interval(F.when(F.weekday(ts) == 4, 3).when(F.weekday(ts) == 5, 2).otherwise(1))

    @staticmethod
    def prev_session(ts: Column) -> Column:
        return ts - F.make_dt_interval(F.when(F.weekday(ts) == 0, 3).when(F.weekday(ts) == 6, 2).otherwise(1))

    def minutes(self, spark: SparkSession, start: Any, end: Any, freq: timedelta) -> DataFrame:
        """ts_utc: steps of freq after each session's open up to its close, within [start, end]."""
        s = self.sessions(spark, start, end)
        # In compat form a label's session falls on the day before; labels just outside can still reach in.
        ticks = s.select(self.open(F.col("session")).alias("o"), self.close(F.col("session")).alias("c"))
        grid = ticks.select("o", F.explode(F.sequence("o", "c", interval(freq))).alias("ts_utc")).where("ts_utc > o")
        return grid.where(F.col("ts_utc").between(at(start), at(end))).select("ts_utc").distinct()


def build_grid(spark: SparkSession, calendar: TradingCalendar, start: Any, end: Any, grid: str) -> DataFrame:
    """ts_utc of a named grid: b, sessions or daily for session closes (sessions picked by date, closes not clipped to the clock), or like 5min for ticks."""
    name = grid.strip().lower()
    if name in ("b", "sessions", "daily"):
        return calendar.sessions(spark, start, end).select(calendar.close(F.col("session")).alias("ts_utc"))
    if m := re.fullmatch(r"(\d+)\s*(?:min|t)", name):
        return calendar.minutes(spark, start, end, timedelta(minutes=int(m[1])))
    raise ValueError(f"unknown grid {grid!r}")


@dataclass(frozen=True)
class SessionCloseEvents:
    """Events at session closes, late by `delay`."""

    calendar: str = "XNYS"
    delay: timedelta = timedelta(0)

    def events(self, ctx: Any, start: Any, end: Any, entities: Any = None) -> DataFrame:
        return build_grid(ctx.spark, ctx.calendars[self.calendar], start, end, "sessions").select((F.col("ts_utc") + interval(self.delay)).alias("ts_utc"))


@dataclass(frozen=True)
class FixedIntervalEvents:
    """Events every `freq` within sessions, late by `delay`."""

    calendar: str = "XNYS"
    freq: timedelta = timedelta(minutes=5)
    delay: timedelta = timedelta(0)

    def events(self, ctx: Any, start: Any, end: Any, entities: Any = None) -> DataFrame:
        return ctx.calendars[self.calendar].minutes(ctx.spark, start, end, self.freq).select((F.col("ts_utc") + interval(self.delay)).alias("ts_utc"))


@dataclass(frozen=True)
class EventGrid:
    """Given timestamps as a grid: a DataFrame with ts_utc."""

    timestamps: DataFrame
    name: str = "events"

    def normalized(self, start: Any = None, end: Any = None) -> DataFrame:
        """Distinct and within the bounds, both included."""
        out = self.timestamps.select("ts_utc").where("ts_utc IS NOT NULL")
        out = out if start is None else out.where(F.col("ts_utc") >= at(start))
        return (out if end is None else out.where(F.col("ts_utc") <= at(end))).distinct()
