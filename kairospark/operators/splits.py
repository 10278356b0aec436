"""Time-series splits over a column of dates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairospark.functions.times import interval
from kairospark.operators.scans import neighbours, numbered, scanned


def _numbered(dates: DataFrame) -> tuple[DataFrame, int]:
    """(d, i) with positions from 0, and the number of dates. Dates can be intraday times of any number: no task has all of them."""
    return numbered(dates.select(F.col(dates.columns[0]).cast("timestamp_ntz").alias("d")), "d")


def _every(start: int, step: int) -> Column:
    return (F.col("i") >= start) & ((F.col("i") - start) % step == 0)


def rolling_splits(dates: DataFrame, train: int, test: int, step: int = 1) -> DataFrame:
    """train_start, train_end, test_start, test_end of windows of fixed length. Each date is sent to the splits that it bounds: one shuffle of four rows a date at most."""
    made = neighbours(_numbered(dates)[0], "i", {"train_start": ("d", -train), "train_end": ("d", -1), "test_start": ("d", 0), "test_end": ("d", test - 1)}, _every(train, step))
    return made.where("train_start IS NOT NULL AND test_end IS NOT NULL").drop("i")


def expanding_splits(dates: DataFrame, least: int, test: int, step: int = 1) -> DataFrame:
    """The same with training from the first date on."""
    positions, _ = _numbered(dates)
    made = neighbours(positions, "i", {"train_end": ("d", -1), "test_start": ("d", 0), "test_end": ("d", test - 1)}, _every(least, step)).where("train_end IS NOT NULL AND test_start IS NOT NULL AND test_end IS NOT NULL")
    first = positions.agg(F.min("d").alias("train_start"))
    return made.crossJoin(F.broadcast(first)).select("train_start", "train_end", "test_start", "test_end")


def _moved(day, business_days: int):
    """A date moved by business days, a weekend first rolled in the direction of the move."""
    n, back = abs(business_days), business_days < 0
    wd = F.weekday(day)
    if back:
        base = F.date_sub(day, F.when(wd == 5, 0).when(wd == 6, 1).otherwise(0))
        on = F.least(wd, F.lit(5))  # Saturday and Sunday count as just after Friday
        return F.date_sub(base, F.lit(n) + 2 * F.floor((F.lit(n + 4) - on) / 5).cast("int") + F.when(wd >= 5, 0).otherwise(0))
    on = F.when(wd >= 5, -1).otherwise(wd)  # and just before Monday
    base = F.date_add(day, F.when(wd == 5, 1).otherwise(0))
    return F.date_add(base, F.lit(n) + 2 * F.floor((F.lit(n) + on) / 5).cast("int"))


def _folds(positions: DataFrame, n: int, n_splits: int) -> DataFrame:
    size = n // n_splits
    fold = F.least(F.floor(F.col("i") / size), F.lit(n_splits - 1)).cast("int") if size else F.lit(n_splits - 1)
    return positions.select(fold.alias("fold"), "d")


def purged_kfold(dates: DataFrame, n_splits: int = 5, embargo: int = 0) -> DataFrame:
    """(fold, role, date): consecutive test folds of n // n_splits dates, the last with the rest, empty ones left out. Training dates are distinct and outside the fold, with an embargo also outside that many business days around it."""
    positions, n = _numbered(dates)
    folds = _folds(positions, n, n_splits)
    bounds = folds.groupBy("fold").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    if embargo:
        bounds = bounds.select("fold", _moved(F.col("low").cast("date"), -embargo).cast("timestamp_ntz").alias("low"), _moved(F.col("high").cast("date"), embargo).cast("timestamp_ntz").alias("high"))
    outside = (F.col("d") < F.col("low")) | (F.col("d") > F.col("high"))
    train = positions.select("d").distinct().join(F.broadcast(bounds), outside).select("fold", F.lit("train").alias("role"), F.col("d").alias("date"))
    return folds.select("fold", F.lit("test").alias("role"), F.col("d").alias("date")).unionByName(train)


def overlapping(rows: DataFrame, spans: DataFrame, *, key: str, start: str = "ts_utc", end: str = "target_end", segment: timedelta | None = None) -> DataFrame:
    """rows with `overlaps`: whether some span (low, high) of the row's key meets the row's own [start, end], ends included.

    A sweep over rows, by their ends, and spans, by their lows: of the spans that begin up to a row's end, the one that lasts longest must reach the row's start. One shuffle by key, or by key and ranges of time, however many spans there are; no pairs are made. An end that is NULL or before its start counts as the start. A row without a time meets nothing; a span without both ends isn't one.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    asked = rows.select(F.col(f"`{key}`").alias("key"), F.greatest(F.col(f"`{start}`"), F.col(f"`{end}`")).alias("at"), F.lit(1).alias("side"), F.col(f"`{start}`").alias("since"), whole.alias("row"), F.lit(None).cast("timestamp_ntz").alias("high"))
    told = spans.where("low IS NOT NULL AND high IS NOT NULL AND low <= high").select(F.col(f"`{key}`").alias("key"), F.col("low").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "high")
    swept = scanned(asked.unionByName(told), greatest={"until": F.col("high")}, key="key", time="at", ties=("side",), segment=segment)
    return swept.where("side = 1").select("row.*", F.coalesce(F.col("until") >= F.col("since"), F.lit(False)).alias("overlaps"))


def target_purged_kfold(rows: DataFrame, n_splits: int = 5, *, start: str = "ts_utc", end: str = "target_end", embargo: timedelta = timedelta(0), segment: timedelta | None = timedelta(days=30)) -> DataFrame:
    """rows with fold and role: for each of n_splits consecutive folds of their distinct times its rows as test, and as train those of all other folds whose time up to its target's end doesn't meet the span of the test rows and their targets (and the embargo after it).

    A row is in the result up to once a fold. Fold bounds, n_splits pairs of times, are known to the driver; each fold's span is an aggregate, and rows and spans meet in one sweep by fold and ranges of time. NULL targets' ends count as the row's own time; rows without a time are left out.
    """
    if clash := [c for c in ("fold", "role", "overlaps") if c in rows.columns]:
        raise ValueError(f"the rows have columns {clash} already")
    own = rows.where(F.col(start).isNotNull())
    positions, n = _numbered(own.select(F.col(start).alias("d")).distinct())
    bounds = sorted(map(tuple, _folds(positions, n, n_splits).groupBy("fold").agg(F.min("d")).collect()))
    fold = F.lit(bounds[0][0] if bounds else 0)
    for k, low in bounds[1:]:
        fold = F.when(F.col(start) >= F.lit(low.isoformat(sep=" ")).cast("timestamp_ntz"), k).otherwise(fold)
    each = own.withColumn("fold", fold)
    spans = each.groupBy("fold").agg(F.min(start).alias("low"), (F.max(F.greatest(start, end)) + interval(embargo)).alias("high"))
    others = own.withColumn("__own", fold).withColumn("fold", F.explode(F.array(*(F.lit(k) for k, _ in bounds)) if bounds else F.array(F.lit(0)))).where(F.col("fold") != F.col("__own"))
    train = overlapping(others.drop("__own"), spans, key="fold", start=start, end=end, segment=segment).where(~F.col("overlaps")).drop("overlaps")
    return each.withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train")))
