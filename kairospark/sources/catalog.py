"""What a source offers and how it is asked."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairospark.functions.times import at, to_utc, utc
from kairospark.operators.panel import entity_frame

#: Days between a series' points by native frequency.
CADENCE = {"B": 1, "D": 1, "W": 7, "M": 30, "Q": 90}


@dataclass(frozen=True)
class Query:
    table: str
    columns: Sequence[str] = ()
    start: Any = None
    end: Any = None
    entities: Sequence[Any] | DataFrame | None = None
    asof: Any = None
    vintage: str | None = None
    vintage_id: str | None = None
    grid: str | None = None

    def __post_init__(self) -> None:
        for name in ("start", "end", "asof"):
            object.__setattr__(self, name, utc(getattr(self, name)))


@dataclass(frozen=True)
class TableSchema:
    name: str = ""
    required_columns: Sequence[str] = ()
    canonical_columns: Sequence[str] = ()
    entity_column: str = "entity_id"
    time_column: str = "date"
    native_freq: str | None = None
    time_semantics: str | None = None
    expected_cadence_days: int | None = None
    event_time_column: str | None = None
    release_time_column: str | None = None
    revision_id_column: str | None = None

    def cadence(self) -> int | None:
        """Expected days between points: as given, else by frequency, else unknown."""
        return self.expected_cadence_days if self.expected_cadence_days is not None else CADENCE.get((self.native_freq or "").upper())


class DataSource(Protocol):
    """fetch returns a lazy long table: time, entity and the asked columns, with what it can push down pushed down."""

    name: str

    def schemas(self) -> dict[str, TableSchema]: ...

    def fetch(self, q: Query) -> DataFrame: ...


@dataclass(frozen=True)
class FrameSource:
    """Tables that are DataFrames, such as Parquet scans: columns are pruned, and time bounds, entities and as-of are filters that reach the scan."""

    name: str
    tables: dict[str, DataFrame]
    table_schemas: dict[str, TableSchema]

    @staticmethod
    def parquet(spark: SparkSession, name: str, paths: dict[str, str], schemas: dict[str, TableSchema]) -> FrameSource:
        return FrameSource(name, {t: spark.read.parquet(p) for t, p in paths.items()}, schemas)

    def schemas(self) -> dict[str, TableSchema]:
        return self.table_schemas

    def fetch(self, q: Query) -> DataFrame:
        df, schema = self.tables[q.table], self.table_schemas.get(q.table, TableSchema(q.table))
        time = to_utc(df, schema.time_column)
        for bound, keep in ((q.start, lambda b: time >= b), (q.end, lambda b: time <= b), (q.asof, lambda b: time <= b)):
            if bound is not None:
                df = df.where(keep(at(bound)))
        if q.entities is not None and not isinstance(q.entities, DataFrame):  # those of a DataFrame are kept by sliced()
            entity, names = F.col(schema.entity_column), [str(e) for e in q.entities]
            if dict(df.dtypes)[schema.entity_column] in ("bigint", "int", "smallint", "tinyint"):
                # Whole numbers are compared as such, so that the filter reaches the scan; a name that is none matches nothing.
                df = df.where(entity.isin([int(e) for e in names if str(e).lstrip("-").isdigit() and str(int(e)) == e]))
            else:
                df = df.where(entity.cast("string").isin(names))
        keys = [schema.time_column, schema.entity_column]
        return df.select(*keys, *(c for c in q.columns if c not in keys)) if q.columns else df


class SeriesSource:
    """A service with one request a series: reader(series, start, end, vintage day) gives (date, value) rows; series are dealt over `most_tasks` tasks at most (as many as the session has cores, by default), each of which asks for its own one after the other, and rows carry the vintage day as asof_utc. No network code is included: the reader is the caller's."""

    def __init__(self, spark: SparkSession, name: str, table: str, reader: Any, most_tasks: int | None = None):
        self.spark, self.name, self.table, self.reader, self.most_tasks = spark, name, table, reader, most_tasks or spark.sparkContext.defaultParallelism

    def schemas(self) -> dict[str, TableSchema]:
        return {self.table: TableSchema(self.table, entity_column="series_id", time_column="date")}

    def fetch(self, q: Query) -> DataFrame:
        from datetime import datetime, timezone

        if q.entities is None or not isinstance(q.entities, DataFrame) and not q.entities:
            raise ValueError("entities are needed: one request is made for each")
        reader, start, end = self.reader, q.start, q.end
        asof = q.asof or datetime.now(timezone.utc).replace(tzinfo=None)
        day = asof.replace(hour=0, minute=0, second=0, microsecond=0)

        def read(frames: Iterable[Any]) -> Iterable[Any]:
            import pandas as pd

            for frame in frames:
                for series in frame["series_id"]:
                    got = pd.DataFrame(list(reader(series, start, end, day)), columns=["date", "value"])
                    yield got.assign(date=pd.to_datetime(got["date"]), value=got["value"].astype(float), series_id=series, asof_utc=pd.Timestamp(day))

        names = entity_frame(self.spark, q.entities).withColumnRenamed("entity_id", "series_id")
        n = names.count() if isinstance(q.entities, DataFrame) else len(q.entities)
        names = names.repartition(min(self.most_tasks, max(1, n)))
        return names.mapInPandas(read, "date timestamp_ntz, value double, series_id string, asof_utc timestamp_ntz")
