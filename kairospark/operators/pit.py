"""Bitemporal observations: one row for (series_key, obs_date, asof_utc)."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kairospark.files import exists, names, remove
from kairospark.functions.ref_period import RefPeriod
from kairospark.functions.times import at, known, to_utc
from kairospark.operators.scans import scanned

# The table's columns and keys.
SCHEMA = "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double, release_time_utc timestamp_ntz, revision_id string, source string, meta_json string, ingested_utc timestamp_ntz"
KEY = ("series_key", "obs_date", "asof_utc")
NEEDED = (*KEY, "value")


def normalized(df: DataFrame, now: Any = None) -> DataFrame:
    """Observations with all columns of the table: times in UTC, absent columns NULL, ingested_utc now by default. ValueError without a needed column."""
    if lacking := [c for c in NEEDED if c not in df.columns]:
        raise ValueError(f"missing columns: {lacking}")
    out = []
    for part in SCHEMA.split(", "):
        name, kind = part.split(" ")
        if name not in df.columns:
            col = (at(now) if now is not None else F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))) if name == "ingested_utc" else F.lit(None).cast(kind)
        else:
            col = to_utc(df, name) if kind == "timestamp_ntz" else F.col(name).cast(kind)
        out.append(col.alias(name))
    return known(df.select(*out))


def merged(*parts: DataFrame, by_range: bool = False) -> DataFrame:
    """Upserts one after the other: of rows with the same key that of the last part stays, of one part's the latest ingested. Partial aggregation by key before the shuffle. by_range: rows are dealt out by ranges of series_key first, which serves the aggregation too, so that one shuffle and one sort do for parts that have each key once."""
    every = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    rest = [c.split(" ")[0] for c in SCHEMA.split(", ") if c.split(" ")[0] not in KEY]
    order = F.struct("__part", F.col("ingested_utc").isNotNull(), "ingested_utc")
    rows = reduce(DataFrame.unionByName, every)
    last = (rows.repartitionByRange("series_key") if by_range else rows).groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return last.select(*KEY, "v.*")


def snapshot(pit: DataFrame, asof: Any, *, series_key: str | None = None, start: Any = None, end: Any = None, method: str = "latest_leq") -> DataFrame:
    """series_key, obs_date, asof_utc, value as known at asof: of each observation the latest vintage up to then; a missing latest value hides older ones. Partial aggregation, no sort."""
    if method != "latest_leq":
        raise ValueError(f"unknown method {method!r}")
    df = pit.where(F.col("asof_utc") <= at(asof))
    if series_key is not None:
        df = df.where(F.col("series_key") == series_key)
    if start is not None:
        df = df.where(F.col("obs_date") >= at(start))
    if end is not None:
        df = df.where(F.col("obs_date") <= at(end))
    last = df.groupBy("series_key", "obs_date").agg(F.max_by(F.struct("asof_utc", "value"), "asof_utc").alias("v"))
    return last.select("series_key", "obs_date", "v.asof_utc", "v.value")


def asof_values(rows: DataFrame, pit: DataFrame, *, key: str = "series_key", time: str = "ts_utc", obs: str | None = None, future: bool = False, segment: timedelta | None = None) -> DataFrame:
    """rows with obs_date, asof_utc and value as they were known at each row's own time: of its series the latest vintage of the latest observation, or, with a column `obs` of dates, of that observation.

    A vintage is known from its asof_utc on, both included; unless `future`, one of an observation date that is yet to come counts from that date on. A missing latest value hides older ones, as in snapshot(). NULL where nothing was known, or without a series, time or date. All rows stay, repeated ones too.
    One sweep over the union of rows and vintages in the order of when they are known: one shuffle by series, or by series and ranges of time with a `segment`, for series that hold a large share of all rows.
    """
    made = ("obs_date", "asof_utc", "value")
    if clash := [c for c in rows.columns if c in made and c != obs]:
        raise ValueError(f"the rows have columns {clash} already")
    known_at = F.col("asof_utc") if future else F.greatest("asof_utc", "obs_date")
    vintage = F.struct("obs_date", "asof_utc", "value")
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    place = F.struct(F.col(f"`{key}`").cast("string").alias("series"), (F.col(f"`{obs}`").cast("timestamp_ntz") if obs else F.lit(None).cast("timestamp_ntz")).alias("obs"))
    asked = rows.select(place.alias("key"), to_utc(rows, time).alias("at"), F.lit(1).alias("side"), whole.alias("row"), F.lit(None).cast(pit.select(vintage.alias("v")).schema["v"].dataType).alias("v"))
    told = pit.where(F.col("asof_utc").isNotNull() & F.col("series_key").isNotNull()).select(F.struct(F.col("series_key").alias("series"), (F.col("obs_date") if obs else F.lit(None).cast("timestamp_ntz")).alias("obs")).alias("key"), known_at.alias("at"), F.lit(0).alias("side"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), vintage.alias("v"))
    swept = scanned(asked.unionByName(told), greatest={"now": F.col("v")}, key="key", time="at", ties=("side",), segment=segment)
    usable = F.col("at").isNotNull() & F.col("key.series").isNotNull()
    return swept.where("side = 1").select("row.*", *(F.when(usable, F.col("now")[c]).alias(c) for c in made if c != obs))


def timeline(pit: DataFrame, obs_date: Any, *, series_key: str | None = None, start_asof: Any = None, end_asof: Any = None) -> DataFrame:
    """All vintages of one observation date, oldest first."""
    df = pit.where(F.col("obs_date") == at(obs_date))
    if series_key is not None:
        df = df.where(F.col("series_key") == series_key)
    if start_asof is not None:
        df = df.where(F.col("asof_utc") >= at(start_asof))
    if end_asof is not None:
        df = df.where(F.col("asof_utc") <= at(end_asof))
    return df.select("series_key", "obs_date", "asof_utc", "value").orderBy("series_key", "asof_utc")


def period_end(ref: str | RefPeriod | None, freq: str | None = None) -> Any:
    if ref is None:
        return None
    period = RefPeriod.parse(ref) if isinstance(ref, str) else ref
    if freq is not None and period.freq != freq:
        raise ValueError(f"{period.key()} is not of frequency {freq}")
    return period.end()


def timeline_ref(pit: DataFrame, ref: str | RefPeriod, *, freq: str | None = None, **how: Any) -> DataFrame:
    return timeline(pit, period_end(ref, freq), **how)


def snapshot_ref(pit: DataFrame, asof: Any, start_ref: str | RefPeriod | None = None, end_ref: str | RefPeriod | None = None, *, freq: str | None = None, **how: Any) -> DataFrame:
    """Both bounds stand for their period's end."""
    return snapshot(pit, asof, start=period_end(start_ref, freq), end=period_end(end_ref, freq), **how)


class PitTable:
    """The table on shared storage: a log of parts, each an upsert's rows with every key once, merged when read. After `most_parts` upserts they are made one part. So an upsert writes its own rows and, over time, each row as often as there are compactions.

    A part's rows are dealt out by ranges of series_key and sorted, with bounds of each file's keys beside it (`bounds`) and, in compacted parts, Bloom filters on it, so a read of one series opens the files whose bounds hold it, one or two a part, and in them the row groups that may have it.
    A manifest names the parts, so readers see an upsert whole or not at all. Parts that neither the current nor the last manifest names are removed. One writer at a time: of two with the same manifest number the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str, most_parts: int = 16, row_group_bytes: int = 8 << 20):
        self.spark, self.root, self.most_parts, self.row_group_bytes = spark, root.rstrip("/"), most_parts, row_group_bytes

    def _manifest(self) -> tuple[int, list[str]]:
        numbers = [int(n.removeprefix("m-")) for n in names(self.spark, f"{self.root}/manifests") if exists(self.spark, f"{self.root}/manifests/{n}/_SUCCESS")]
        if not numbers:
            return 0, []
        return max(numbers), self.spark.read.schema("parts array<string>").json(f"{self.root}/manifests/m-{max(numbers)}").first()["parts"]

    def _publish(self, number: int, parts: list[str]) -> None:
        before = self._manifest()[1]
        self.spark.range(0, 1, 1, 1).select(F.array(*map(F.lit, parts)).alias("parts")).write.json(f"{self.root}/manifests/m-{number}")
        for name in names(self.spark, f"{self.root}/parts"):
            if name not in (*parts, *before):
                remove(self.spark, f"{self.root}/parts/{name}")
                remove(self.spark, f"{self.root}/bounds/{name}")
        if number > 2:
            remove(self.spark, f"{self.root}/manifests/m-{number - 2}")

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/parts/{name}")

    def _write(self, dealt: DataFrame, name: str, filters: str = "false") -> tuple[int, int]:
        """Writes a part, which is dealt out by ranges of series_key, and its bounds, and gives the rows with a NULL key and those with the key of the row before, counted on the way: ranges of series are sorted by key anyway, so the window takes neither a shuffle nor a sort of its own."""
        path, seen = f"{self.root}/parts/{name}", Observation()
        before = F.lag("asof_utc").over(Window.partitionBy("series_key", "obs_date").orderBy("asof_utc"))
        counted = dealt.withColumn("__again", before == F.col("asof_utc")).observe(seen, F.count_if(F.greatest(*(F.col(k).isNull() for k in KEY))).alias("no_key"), F.count_if("__again").alias("again"))
        counted.drop("__again").write.option("parquet.bloom.filter.enabled#series_key", filters).option("parquet.block.size", self.row_group_bytes).parquet(path)
        # Where no row lacks a key, no file has one, and series_key alone is read again.
        lacking = F.count_if(F.greatest(*(F.col(k).isNull() for k in KEY))) if seen.get["no_key"] else F.lit(0).cast("long")
        own = self._part(name).groupBy(F.input_file_name().alias("file")).agg(F.min("series_key").alias("low"), F.max("series_key").alias("high"), F.count("*").alias("n_rows"), lacking.alias("no_key"))
        own.coalesce(1).write.parquet(f"{self.root}/bounds/{name}")
        return seen.get["no_key"], seen.get["again"]

    def bounds(self) -> DataFrame:
        """file, low, high, n_rows, no_key, part: the keys that each file of the current parts has."""
        kinds = "file string, low string, high string, n_rows long, no_key long"
        parts = [self.spark.read.schema(kinds).parquet(f"{self.root}/bounds/{p}").withColumn("part", F.lit(p)) for p in self._manifest()[1]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kinds + ", part string")

    def files_with(self, series_key: str) -> list[str]:
        return [r.file for r in self.bounds().where((F.col("low") <= series_key) & (F.col("high") >= series_key)).collect()]

    def read(self, series_key: str | None = None) -> DataFrame:
        """All observations, or those of one series from the files that may have it."""
        names_ = self._manifest()[1]
        if series_key is None:
            parts = [self._part(p) for p in names_]
        else:
            held = self.bounds().where((F.col("low") <= series_key) & (F.col("high") >= series_key)).groupBy("part").agg(F.collect_list("file")).collect()
            files = {r[0]: r[1] for r in held}  # one or two a part, and few parts
            parts = [self.spark.read.schema(SCHEMA).parquet(*files[p]).where(F.col("series_key") == series_key) for p in names_ if p in files]
        return merged(*parts) if len(parts) > 1 else parts[0] if parts else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, df: DataFrame, *, now: Any = None, last_wins: bool = False) -> None:
        """Inserts or replaces by key. NULL keys raise, and so do repeated keys within the batch unless last_wins (the latest ingested_utc). The batch is evaluated once, written, and checked while it is written; a refused one is removed."""
        new, name = normalized(df, now), f"p-{uuid.uuid4().hex}"
        number, parts = self._manifest()
        no_key, again = self._write((merged(new) if last_wins else new).repartitionByRange("series_key"), name)
        fault = "a key column is NULL" if no_key else "a key repeats within the batch" if again else None
        if fault:
            remove(self.spark, f"{self.root}/parts/{name}")
            remove(self.spark, f"{self.root}/bounds/{name}")
            raise ValueError(fault)
        self._publish(number + 1, [*parts, name])
        if len(parts) + 1 > self.most_parts:
            self.compact()

    def compact(self) -> None:
        """All parts as one."""
        (number, held), name = self._manifest(), f"p-{uuid.uuid4().hex}"
        every = merged(*map(self._part, held), by_range=True) if len(held) > 1 else self.read().repartitionByRange("series_key")
        self._write(every, name, "true")  # a filter takes up to a megabyte a file, too much for a small upsert
        self._publish(number + 1, [name])
