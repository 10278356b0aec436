"""The dataset build: one lazy plan from a declarative specification."""

from __future__ import annotations

import warnings
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kairospark.functions.calendars import EventGrid, TradingCalendar, build_grid
from kairospark.functions.times import at, interval, known, utc
from kairospark.operators.joins import grid_by_entities, join_frames, next_in_grid
from kairospark.operators.panel import KEYS, entity_frame, ordered, unique, unique_in_plan
from kairospark.plans.specs import DatasetArtifact, DatasetSpec, FeatureFrame, FeatureRequest, SliceSpec, TargetFrame, TargetRequest


def resolve_grid(ctx: Any, calendar: TradingCalendar, spec: DatasetSpec) -> DataFrame:
    """ts_utc by the kind of spec.time.grid: an event source within the bounds, an event grid as it is, or a name. Each time once."""
    grid, t = spec.time.grid, spec.time
    if hasattr(grid, "events"):
        return grid.events(ctx, t.start, t.end, spec.universe.entities).select("ts_utc").distinct()
    if isinstance(grid, EventGrid):
        return grid.normalized()
    if not isinstance(grid, str):
        raise TypeError(f"no grid: {grid!r}")
    return build_grid(ctx.spark, calendar, t.start, t.end, grid)


def _materialized(ctx: Any, request: Any, base: SliceSpec) -> Any:
    s = request.slice_override.applied(base) if request.slice_override else base
    template = request.template
    state = template.fit(ctx, request.params, s) if hasattr(template, "fit") else None
    return template.transform(ctx, request.params, s, state), s


def leaked(frame: DataFrame, asof: Any) -> DataFrame:
    """n_leaked: the rows after asof."""
    return frame.agg(F.count_if(F.col("ts_utc") > at(asof)).alias("n_leaked"))


def to_closes(frame: DataFrame, calendar: TradingCalendar) -> DataFrame:
    return frame.withColumn("ts_utc", calendar.close(F.col("ts_utc")))


def _labelled(frame: FeatureFrame) -> bool:
    """Whether times are session labels: as the frame says, else if all are at hour 0, which takes a job."""
    if frame.labels is not None:
        return frame.labels == "session"
    hours = frame.x.agg(F.max(F.hour("ts_utc"))).first()[0]
    return hours == 0


def _feature(ctx: Any, request: FeatureRequest, base: SliceSpec, calendar: TradingCalendar, spec: DatasetSpec, on_leak: str | None, meta: dict[str, Any]) -> FeatureFrame:
    frame, s = _materialized(ctx, request, base)
    frame.validate()
    x = known(frame.x, KEYS)
    if s.asof is not None and on_leak:
        n = leaked(x, s.asof).first()[0] if on_leak != "drop" else 0
        if n:
            text = f"{getattr(request.template, 'name', request.template)} returned {n} rows with timestamps after asof"
            if on_leak == "raise":
                raise ValueError(text)
            warnings.warn(text, UserWarning, stacklevel=4)
            meta["leak_detected"] = True
        if on_leak == "drop":
            x = x.where(F.col("ts_utc") <= at(s.asof))
    if _labelled(frame):
        x = to_closes(x, calendar)
    if request.broadcast_entities:
        x = x.drop("entity_id").crossJoin(entity_frame(ctx.spark, spec.universe.entities))
    out = FeatureFrame(x, frame.catalog, frame.meta, frame.artifacts)
    return out.with_tags(request.tags, overwrite=False) if request.tags else out


def _target(ctx: Any, request: TargetRequest, base: SliceSpec, calendar: TradingCalendar, entities: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
    """ts_utc, entity_id, y, and the target's own meta. Values without an entity are of session labels and hold for all entities."""
    got, _ = _materialized(ctx, request, base)
    if isinstance(got, TargetFrame):
        y = got.y
    elif isinstance(got, FeatureFrame):
        y = got.x
    elif isinstance(got, DataFrame):
        y = got
    else:
        raise TypeError(f"no target: {type(got).__name__}")
    values = [c for c in y.columns if c not in KEYS]
    if len(values) != 1:
        raise ValueError(f"a target has one column, not {values}")
    y = known(y, KEYS)
    if "entity_id" not in y.columns:
        y = to_closes(y, calendar).crossJoin(entities)
    own = dict(got.meta) if isinstance(got, TargetFrame) else {}
    compat = {} if isinstance(got, TargetFrame) else {"compat": "FeatureFrame" if isinstance(got, FeatureFrame) else "Series"}
    return y.select(*KEYS, F.col(f"`{values[0]}`").alias(request.name)), own | {"horizon": request.horizon, "name": request.name} | compat


def build_dataset(ctx: Any, spec: DatasetSpec, *, persist: str | None = None, on_leak: str | None = "warn", check_keys: bool | str = True) -> DatasetArtifact:
    """The grid of all times and entities, left-joined with every feature and the target, and the missingness policy.

    Joins are all on (ts_utc, entity_id). With drop_if_any_nan Catalyst turns the outer joins into inner ones. on_leak: warn, raise or drop rows after as-of, or None for no check; check_keys: repeated keys of a frame raise at once; "plan": they fail the job that reads the data. The first two take a job for each frame; all else is lazy. persist: a path to write the data to and read it back from. meta has the calendar, grid, bounds and number of features; n_rows too once the data are persisted, else DatasetArtifact.described() counts them.
    """
    if spec.universe.entities.isEmpty() if isinstance(spec.universe.entities, DataFrame) else not spec.universe.entities:
        raise ValueError("the universe is empty")
    if spec.join_policy.how not in ("inner", "outer"):
        raise ValueError(f"unknown join {spec.join_policy.how!r}")
    if spec.missingness.final_row_policy not in ("drop_if_any_nan", "keep"):
        raise ValueError(f"unknown row policy {spec.missingness.final_row_policy!r}")
    t = spec.time
    calendar = ctx.calendars[t.calendar]
    base = SliceSpec(utc(t.start), utc(t.end), spec.universe.entities if isinstance(spec.universe.entities, DataFrame) else list(spec.universe.entities), utc(t.asof), t.grid if isinstance(t.grid, str) and ":" in t.grid else f"sessions:{t.calendar}")
    grid = resolve_grid(ctx, calendar, spec)
    if grid.isEmpty():
        raise ValueError("the grid is empty")
    entities = entity_frame(ctx.spark, spec.universe.entities)
    index = grid_by_entities(grid, entities)
    meta: dict[str, Any] = {"name": spec.name, "tags": dict(spec.tags), "calendar": t.calendar, "grid": t.grid, "start": str(t.start), "end": str(t.end), "target_horizon": spec.target.horizon}
    frames = [_feature(ctx, r, base, calendar, spec, on_leak, meta) for r in spec.features]
    y, meta["target"] = _target(ctx, spec.target, base, calendar, entities)
    names = [f for frame in frames for f in frame.features]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated feature names: {sorted({n for n in names if names.count(n) > 1})}")
    parts = [f.x for f in frames] + [y]
    if check_keys:
        parts = [unique_in_plan(p) if check_keys == "plan" else unique(p) for p in parts]
    data = reduce(lambda a, b: a.join(b, list(KEYS), "left"), parts, index)
    if spec.missingness.final_row_policy == "drop_if_any_nan":
        data = data.dropna(how="any", subset=[f"`{c}`" if "." in c else c for c in (*names, spec.target.name)])
    if spec.join_policy.sort_index:
        data = ordered(data)
    if persist:
        seen = Observation()
        (data if spec.join_policy.sort_index else data.sortWithinPartitions(*KEYS)).observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(persist)
        data, meta["n_rows"] = ctx.spark.read.parquet(persist), seen.get["n"]
    meta["n_features"] = len(names) if meta.get("n_rows", 1) else 0
    catalog = list({row["feature_id"]: row for f in reversed(frames) for row in reversed(f.catalog)}.values())[::-1]
    if spec.join_policy.sort_index:
        data, catalog = ordered(data) if persist else data, sorted(catalog, key=lambda row: row["feature_id"])
    return DatasetArtifact(data, names, spec.target.name, catalog, meta, {"artifacts": {k: v for f in frames for k, v in f.artifacts.items()}})


def join_feature_frames(frames: list[FeatureFrame], how: str = "inner") -> FeatureFrame:
    """Frames side by side, their catalogs with each feature once (its first entry), artifacts together, and the ids of the parts."""
    x = join_frames([f.x for f in frames], how)
    catalog: dict[str, dict[str, Any]] = {}
    for f in frames:
        for row in f.catalog:
            catalog.setdefault(row["feature_id"], row)
    return FeatureFrame(x, list(catalog.values()), {"realization_ids": [f.meta.get("realization_id") for f in frames]}, {k: v for f in frames for k, v in f.artifacts.items()})


def target_ends(rows: DataFrame, *, grid: DataFrame | None = None, horizon: Any = None) -> DataFrame:
    """rows with target_end: a fixed time on, the next grid time, or NULL if neither is asked. Both raise ValueError."""
    if grid is not None and horizon is not None:
        raise ValueError("a horizon or a grid, not both")
    if horizon is not None:
        return rows.withColumn("target_end", F.col("ts_utc") + interval(horizon))
    return next_in_grid(rows, grid) if grid is not None else rows.withColumn("target_end", at(None))
