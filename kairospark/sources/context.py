"""Wiring of sources, calendars and stores, and the main scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairospark.functions.calendars import TradingCalendar
from kairospark.functions.times import at
from kairospark.operators.panel import from_long, sliced
from kairospark.operators.universe import restricted
from kairospark.sources.catalog import DataSource, Query, TableSchema


@dataclass
class DataContext:
    spark: SparkSession
    sources: dict[str, DataSource] = field(default_factory=dict)
    calendars: dict[str, TradingCalendar] = field(default_factory=lambda: {"XNYS": TradingCalendar()})
    store: Any = None
    universe: DataFrame | None = None  # (date, entity_id, is_member)
    entity_meta: DataFrame | None = None
    pit: Any = None

    def schema(self, source: str, table: str) -> TableSchema:
        return self.sources[source].schemas().get(table, TableSchema(table))

    def fetch_panel(self, source: str, q: Query, *, by_vintage: bool = False, whole_last_session: bool = False) -> DataFrame:
        """The canonical panel of a query, lazy: fetch, canonical keys, asof_utc, daily labels to session closes, time and entity bounds, as-of cut on event time, universe.

        Labels are mapped before the bounds apply, so an end at midnight leaves out that day's session; whole_last_session takes it in. The source is asked for two days more on either side when labels move. by_vintage also cuts a real asof_utc column at q.asof.
        """
        schema = self.schema(source, q.table)
        calendar = None
        if (schema.native_freq or "").upper() in ("B", "D"):
            calendar = self.calendars.get(q.grid.split(":", 1)[1] if q.grid and ":" in q.grid else "XNYS")
        wide = q
        if calendar:
            two = timedelta(days=2)
            wide = Query(q.table, q.columns, q.start and q.start - two, q.end and q.end + two, q.entities, q.asof and q.asof + two, q.vintage, q.vintage_id, q.grid)
        panel = from_long(self.sources[source].fetch(wide), schema.time_column, schema.entity_column)
        if "asof_utc" not in panel.columns:
            panel = panel.withColumn("asof_utc", at(q.asof))
        elif by_vintage and q.asof is not None:
            panel = panel.where(F.col("asof_utc") <= at(q.asof))
        end = q.end
        if calendar:
            panel = panel.withColumn("ts_utc", calendar.close(F.col("ts_utc")))
            end = end + timedelta(days=1) if end is not None and whole_last_session else end
        panel = sliced(panel, q.start, end, q.entities)
        panel = sliced(panel, end=q.asof)
        return restricted(panel, self.universe) if self.universe is not None else panel
