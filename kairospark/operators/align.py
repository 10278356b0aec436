"""Alignment of sparse series to a grid, with fills and typed missingness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kairospark.functions.times import at, to_utc
from kairospark.operators.joins import grid_by_entities
from kairospark.operators.panel import unique, unique_in_plan
from kairospark.operators.scans import scanned
from kairospark.sources.catalog import TableSchema

# Availability states.
AVAILABLE, NO_UPDATE_EXPECTED, NOT_YET_RELEASED, TEMPORARY_OUTAGE, DISCONTINUED, MISSING_UNKNOWN = "available", "no_update_expected", "not_yet_released", "temporary_outage", "discontinued", "missing_unknown"


@dataclass(frozen=True)
class AlignSpec:
    """method: none, ffill, step_hold or interp. max_fill_gap_days limits rows of the grid that a value is carried over. match: exact days, or asof for the latest value at or before each grid day. segment: windows go by ranges of time of that length, so that no task has all grid rows of an entity.

    Where the schema names a release time: respect_asof hides what wasn't released yet. A gap of more than cadence_threshold_mult periods since the last known observation is an outage, and, of more than discontinued_mult with nothing known after it, the end of the series. add_missingness_channels: whether the columns __observed and __availability are made.
    """

    method: str = "ffill"
    max_fill_gap_days: int | None = None
    match: str = "exact"
    respect_asof: bool = True
    add_missingness_channels: bool = True
    cadence_threshold_mult: float = 2.5
    discontinued_mult: float = 10.0
    segment: timedelta | None = None


def _order() -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy("ts_utc")


def forward_filled(full: DataFrame, names: Sequence[str], limit: int | None = None, segment: timedelta | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """full with what it takes, and each field's last value, carried over `limit` rows at most."""
    if segment is None:
        w = _order().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
        return full, {f: F.last(F.col(f"`{f}`"), ignorenulls=True).over(w) for f in names}
    if limit is None:
        return scanned(full, {f"__last{k}": F.col(f"`{f}`") for k, f in enumerate(names)}, segment=segment), {f: F.col(f"__last{k}") for k, f in enumerate(names)}
    full = scanned(full, count="__i", segment=segment)
    points = {f"__last{k}": F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.col("__i").alias("i"), F.col(f"`{f}`").alias("x"))) for k, f in enumerate(names)}
    return scanned(full, points, segment=segment), {f: F.when(F.col("__i") - F.col(f"__last{k}.i") <= limit, F.col(f"__last{k}.x")) for k, f in enumerate(names)}


def align_panel(panel: DataFrame, grid: DataFrame, schema: TableSchema, spec: AlignSpec = AlignSpec(), *, fields: Sequence[str] | None = None, asof: Any = None, compat: bool = False, check: bool | str = True) -> DataFrame:
    """For each entity of the panel and each grid row: ts_utc, entity_id, and for each field f its filled value f, f__observed and f__availability.

    Values are looked up by day: the panel's times are floored to it. Observed means that some field had a value on the day. Availability, by the series' cadence: daily or unknown, missing_unknown where all fields are missing, else available; longer, no_update_expected where nothing was observed, else available. compat types the observed days of longer cadences as temporary_outage. One join and one window for all fields. A panel with the schema's release_time_column is aligned by what was released by asof, or, without one, by each grid row's own time: see released(). check: raises at once on repeated (day, entity), one aggregate job, and on an empty panel; "plan": repeated ones fail the job that reads the result, and nothing runs before it; in both other cases an empty panel gives no rows.
    """
    if spec.method not in ("none", "ffill", "step_hold", "interp"):
        raise ValueError(f"unknown method {spec.method!r}")
    release = schema.release_time_column if schema.release_time_column in panel.columns else None
    names = [f for f in (fields or panel.columns) if f not in ("ts_utc", "entity_id", "asof_utc", release)]
    days = panel.select(F.col("ts_utc").cast("date").alias("day"), "entity_id", *(F.col(f"`{f}`") for f in names))
    if check is True:
        if panel.isEmpty():
            raise ValueError("the panel is empty")
        unique(days, ("day", "entity_id"))
    elif check:
        days = unique_in_plan(days, ("day", "entity_id"))
    if release:
        own = unique_in_plan(panel.withColumn("__day", F.col("ts_utc").cast("date")), ("__day", "entity_id")).drop("__day") if check == "plan" else panel
        return _channels(*released(own, grid, schema, spec, names, asof, entities=panel.select("entity_id").distinct()), names, spec)
    full = grid_by_entities(grid, panel.select("entity_id").distinct()).withColumn("day", F.col("ts_utc").cast("date"))
    if spec.match == "asof":
        full = _latest(full, days, names, spec.segment)
    else:
        full = full.join(days, ["day", "entity_id"], "left")
    value = {f: F.col(f"`{f}`") for f in names}
    seen = F.coalesce(*(value[f].cast("string") for f in names)).isNotNull()
    cadence = schema.cadence()
    if cadence is None or cadence <= 1:
        state = F.when(seen, AVAILABLE).otherwise(MISSING_UNKNOWN)
    else:
        state = F.when(seen, TEMPORARY_OUTAGE if compat else AVAILABLE).otherwise(NO_UPDATE_EXPECTED)
    full, filled = _filled(full, names, spec)
    return _channels(full, filled, seen, state, names, spec)


def _channels(full: DataFrame, filled: dict[str, Column], seen: Column, state: Column, names: Sequence[str], spec: AlignSpec) -> DataFrame:
    extra = (lambda f: (seen.alias(f"{f}__observed"), state.alias(f"{f}__availability"))) if spec.add_missingness_channels else lambda f: ()
    return full.select("ts_utc", "entity_id", *(c for f in names for c in (filled[f].alias(f), *extra(f))))


def _filled(full: DataFrame, names: Sequence[str], spec: AlignSpec) -> tuple[DataFrame, dict[str, Column]]:
    """full with what it takes, and each field's value by the method."""
    if spec.method == "none":
        return full, {f: F.col(f"`{f}`") for f in names}
    if spec.method == "interp":
        return _interpolation(full, names, spec.segment)
    return forward_filled(full, names, spec.max_fill_gap_days, spec.segment)


def _interpolation(full: DataFrame, names: Sequence[str], segment: timedelta | None) -> tuple[DataFrame, dict[str, Column]]:
    full = scanned(full, count="__i", segment=segment)
    points = {k: F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.col("__i").alias("i"), F.col(f"`{f}`").cast("double").alias("x"))) for k, f in enumerate(names)}
    full = scanned(full, {f"__before{k}": p for k, p in points.items()}, segment=segment)
    # Seen from the end, as frames that only shrink are computed anew for each row.
    full = scanned(full, {f"__after{k}": p for k, p in points.items()}, segment=segment, backward=True)
    out = {}
    for k, f in enumerate(names):
        before, after, x = F.col(f"__before{k}"), F.col(f"__after{k}"), F.col(f"`{f}`").cast("double")
        share = (F.col("__i") - before["i"]) / F.nullif(after["i"] - before["i"], F.lit(0))
        out[f] = F.coalesce(x, before["x"] + (after["x"] - before["x"]) * share, before["x"], after["x"])
    return full, out


def released(panel: DataFrame, grid: DataFrame, schema: TableSchema, spec: AlignSpec, names: Sequence[str], asof: Any = None, *, entities: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column], Column, Column]:
    """Alignment of observations that each have a release time: the grid rows, their values, whether they were observed, and their availability, for a moment of knowledge: asof, or each grid row's own time.

    Of a grid row whose day has an observation: available if that was released by then, else not_yet_released; temporary_outage if it has no value. Of others: missing_unknown before the first known observation, or where the cadence is daily and the gap within its threshold; no_update_expected between observations of a longer cadence. In a gap beyond the threshold: temporary_outage if an observation after it is known or the gap isn't long enough for discontinued, else that. An observation without a release time was known on its day.
    With respect_asof fills carry the latest observation known, from its release on, over max_fill_gap_days days at most, and nothing else shows; interp then needs an asof, since it looks ahead. Without it values are by day alone, whenever they were released, which leakage_audit() counts.
    Gaps come from one sweep over the union of grid rows, observations and releases, a second one for what comes after where there is an asof: one shuffle by entity, or by entity and ranges of time with spec.segment.
    """
    own_time = asof is None
    if spec.method == "interp" and own_time and spec.respect_asof:
        raise ValueError("interpolation looks ahead: it needs an asof")
    day, entity = F.col("ts_utc").cast("date"), F.col("entity_id")
    value = {f: F.col(f"`{f}`") for f in names}
    has = F.coalesce(*(c.cast("string") for c in value.values())).isNotNull()
    rel = F.coalesce(to_utc(panel, schema.release_time_column), day.cast("timestamp_ntz"))
    obs = panel.select("entity_id", day.alias("day"), rel.alias("release"), has.alias("has"), *value.values())
    start = F.col("day").cast("timestamp_ntz")
    shown = F.struct("day", "release", "has", *value.values())
    told = {"__p": F.when(F.col("has"), F.col("day"))} | {f"__f{k}": F.when(c.isNotNull(), F.struct("day", c.alias("x"))) for k, c in enumerate(value.values())}
    kinds = {n: obs.select(c.alias("x")).schema["x"].dataType for n, c in told.items()} | {"__r": obs.select(shown.alias("x")).schema["x"].dataType}
    none = {n: F.lit(None).cast(kind) for n, kind in kinds.items()}

    def event(df: DataFrame, when: Column, **given: Column) -> DataFrame:
        return df.select(entity, when.alias("at"), F.lit(0).alias("side"), F.lit(None).cast("timestamp_ntz").alias("ts_utc"), *(given.get(n, none[n]).alias(n) for n in kinds))

    index = grid_by_entities(grid, panel.select("entity_id").distinct() if entities is None else entities)
    rows = index.select("entity_id", F.col("ts_utc").alias("at"), F.lit(1).alias("side"), "ts_utc", *(none[n].alias(n) for n in kinds))
    both = rows.unionByName(event(obs, start, __r=shown))
    both = both.unionByName(event(obs, F.greatest(start, "release"), **told) if own_time else event(obs.where(F.col("release") <= at(asof)), start, **told))
    # The releases of the grid row's own time count as known to it.
    swept = scanned(both, last={"r": F.col("__r")}, greatest={n: F.col(f"__{n}") for n in ("p", *(f"f{k}" for k in range(len(names))))}, time="at", ties=("side",), segment=spec.segment)
    if own_time:
        swept = swept.withColumn("q", F.lit(None).cast("date"))
    else:
        swept = scanned(swept, last={"q": F.when(F.col("side") == 0, F.col("__p"))}, time="at", ties=("side",), segment=spec.segment, backward=True)
    full = swept.where("side = 1").withColumns({"day": day, "r": F.when(F.col("r.day") == day, F.col("r"))})
    known_at = F.col("ts_utc") if own_time else at(asof)
    here, out = F.col("r").isNotNull(), F.col("r.release") <= known_at
    cadence = schema.cadence() or 1
    gap, silent = F.datediff("day", "p"), F.datediff(F.col("day") if own_time else at(asof).cast("date"), F.col("p"))
    within = MISSING_UNKNOWN if cadence <= 1 else NO_UPDATE_EXPECTED
    state = (
        F.when(here & ~out, NOT_YET_RELEASED).when(here & F.col("r.has"), AVAILABLE).when(here, TEMPORARY_OUTAGE)
        .when(F.col("p").isNull(), MISSING_UNKNOWN).when(gap <= F.lit(cadence * spec.cadence_threshold_mult), within)
        .when(F.col("q").isNull() & (silent > F.lit(cadence * spec.discontinued_mult)), DISCONTINUED).otherwise(TEMPORARY_OUTAGE)
    )
    seen = F.coalesce(here & F.col("r.has") & (out if spec.respect_asof else F.lit(True)), F.lit(False))
    full = full.select("ts_utc", "entity_id", "day", *(F.when(out if spec.respect_asof else F.lit(True), F.col("r")[f]).alias(f) for f in names), *(F.col(f"f{k}").alias(f"__f{k}") for k in range(len(names))), seen.alias("__seen"), state.alias("__state"))
    if spec.method in ("ffill", "step_hold") and spec.respect_asof:
        near = lambda k: F.datediff("day", F.col(f"__f{k}.day")) <= spec.max_fill_gap_days if spec.max_fill_gap_days is not None else F.lit(True)
        filled = {f: F.when(near(k), F.col(f"__f{k}.x")) for k, f in enumerate(names)}
    else:
        full, filled = _filled(full, names, spec)
    return full, filled, F.col("__seen"), F.col("__state")


def _latest(full: DataFrame, days: DataFrame, names: Sequence[str], segment: timedelta | None) -> DataFrame:
    """Each grid row with the values of the latest day at or before it: one union and one window."""
    values = F.struct(*(F.col(f"`{f}`") for f in names))
    left = full.select("entity_id", F.col("day").cast("timestamp_ntz").alias("at"), "ts_utc", F.lit(1).alias("__side"), F.lit(None).cast(days.select(values.alias("v")).schema["v"].dataType).alias("__v"))
    right = days.select("entity_id", F.col("day").cast("timestamp_ntz").alias("at"), F.lit(None).cast("timestamp_ntz").alias("ts_utc"), F.lit(0).alias("__side"), values.alias("__v"))
    swept = scanned(left.unionByName(right), {"__now": F.col("__v")}, time="at", ties=("__side",), segment=segment)
    return swept.where("__side = 1").select(F.col("at").cast("date").alias("day"), "entity_id", "ts_utc", *(F.col("__now")[f].alias(f) for f in names))
