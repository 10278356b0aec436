"""Built-in feature and target templates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.operators.align import NO_UPDATE_EXPECTED, NOT_YET_RELEASED, AlignSpec, align_panel
from kairospark.operators.joins import grid_by_entities
from kairospark.operators.panel import entity_frame
from kairospark.operators.returns import lagged, log_returns, next_squared_return
from kairospark.plans.ids import feature_id, group_path
from kairospark.plans.specs import FeatureFrame, ParamSpec, SliceSpec, TargetFrame
from kairospark.sources.catalog import Query


class Template:
    version = "1.0"
    param_space: dict[str, ParamSpec] = {}

    def value(self, params: dict[str, Any], name: str) -> Any:
        spec = self.param_space[name]
        return spec.check(params[name]) if name in params else spec.default

    def requires(self, params: dict[str, Any]) -> list[tuple[str, Any]]:
        return []

    def fit(self, ctx: Any, params: dict[str, Any], slice: SliceSpec) -> Any:
        return None


def entry(fid: str, group: str, family: str, transform: str, table: str, col: str) -> dict[str, Any]:
    return dict(feature_id=fid, group_path=group, family=family, transform=transform, source_table=table, source_col=col, tags={}, tags_json="{}")


class CalendarFlags(Template):
    """Of each session and entity: dow (0 is Monday; or dow_0 to dow_6), is_month_end, is_quarter_end, is_year_end, by calendar days."""

    name = "calendar_flags"
    param_space = {"calendar": ParamSpec("categorical", "XNYS"), "flags": ParamSpec("categorical", ("dow", "is_month_end")), "one_hot_dow": ParamSpec("bool", False)}

    def transform(self, ctx: Any, params: dict[str, Any], slice: SliceSpec, state: Any = None) -> FeatureFrame:
        if slice.entities is None or not isinstance(slice.entities, DataFrame) and not slice.entities:
            raise ValueError("the slice needs entities")
        name, flags = self.value(params, "calendar"), self.value(params, "flags")
        flags = flags if isinstance(flags, (list, tuple)) else (flags,)
        day = F.col("ts_utc").cast("date")
        last = day == F.last_day(day)
        made = {"dow": F.weekday(day).cast("double"), "is_month_end": last.cast("double"), "is_quarter_end": (last & (F.month(day) % 3 == 0)).cast("double"), "is_year_end": (last & (F.month(day) == 12)).cast("double")}
        if not (wanted := [f for f in flags if f in made]):
            raise KeyError(f"no known flag in {flags}")
        columns = {}
        for f in wanted:
            columns |= {f"dow_{k}": (F.weekday(day) == k).cast("double") for k in range(7)} if f == "dow" and self.value(params, "one_hot_dow") else {f: made[f]}
        table = f"calendar.{name}"
        ids = {f: feature_id(table, "*", "calendar", f, {}) for f in columns}
        entities = entity_frame(ctx.spark, slice.entities)
        sessions = ctx.calendars[name].sessions(ctx.spark, slice.start, slice.end).withColumnRenamed("session", "ts_utc")
        x = grid_by_entities(sessions, entities).select("ts_utc", "entity_id", *(c.alias(ids[f]) for f, c in columns.items()))
        group = group_path("calendar", "flags", {})
        extra = {f: {"dow": int(f[4:]), "one_hot": True} if f.startswith("dow_") else {"one_hot": False} if f == "dow" else {} for f in columns}
        return FeatureFrame(x, [entry(ids[f], group, "calendar", f, table, "(derived)") | extra[f] for f in columns], {"template": self.name, "version": self.version}, labels="session")


class LagReturns(Template):
    """Lags 1 to n of the log return."""

    name = "lag_returns"
    param_space = {"lags": ParamSpec("int", 5, 1, 252), "source": ParamSpec("categorical", None), "table": ParamSpec("categorical", "market.ohlcv"), "price_col": ParamSpec("categorical", "close")}

    def _query(self, params: dict[str, Any], slice: SliceSpec | None = None) -> Query:
        s = slice or SliceSpec(None, None)
        return Query(self.value(params, "table"), [self.value(params, "price_col")], s.start, s.end, s.entities, s.asof, grid=s.grid)

    def requires(self, params: dict[str, Any]) -> list[tuple[str, Any]]:
        return [(self.value(params, "source"), self._query(params))]

    def transform(self, ctx: Any, params: dict[str, Any], slice: SliceSpec, state: Any = None) -> FeatureFrame:
        table, n = self.value(params, "table"), self.value(params, "lags")
        panel = ctx.fetch_panel(self.value(params, "source"), self._query(params, slice))
        ids = {k: feature_id(table, "*", "lag", "logret", {"k": k}) for k in range(1, n + 1)}
        x = lagged(log_returns(panel, self.value(params, "price_col")), "logret", list(ids), ids.get)
        return FeatureFrame(x, [entry(f, group_path("lag", "logret", {"k": k}), "lag", "logret", table, self.value(params, "price_col")) for k, f in ids.items()], labels="instant")


class MacroCarry(Template):
    """A sparse series carried onto the session grid, and a flag for values that are missing as none was due or released yet."""

    name = "macro_carry"
    param_space = {"value_col": ParamSpec("categorical", "value"), "method": ParamSpec("categorical", "ffill", choices=("ffill", "step_hold", "interp", "none")), "source": ParamSpec("categorical", None), "table": ParamSpec("categorical", "macro.series"), "calendar": ParamSpec("categorical", "XNYS"), "entities": ParamSpec("categorical", None), "match": ParamSpec("categorical", "exact")}

    def transform(self, ctx: Any, params: dict[str, Any], slice: SliceSpec, state: Any = None) -> FeatureFrame:
        get = lambda k: self.value(params, k)
        table, col = get("table"), get("value_col")
        panel = ctx.fetch_panel(get("source"), Query(table, [col], slice.start, slice.end, get("entities"), slice.asof, grid=slice.grid))
        grid = ctx.calendars[get("calendar")].sessions(ctx.spark, slice.start, slice.end).withColumnRenamed("session", "ts_utc")
        own = align_panel(panel, grid, ctx.schema(get("source"), table), AlignSpec(get("method"), match=get("match")), fields=[col])
        value, flag = feature_id(table, "*", "macro", "carry", {"col": col, "method": get("method")}), feature_id(table, "*", "macro", "missing_structural", {"col": col})
        state_of = F.col(f"`{col}__availability`")
        x = own.select("ts_utc", "entity_id", F.col(f"`{col}`").alias(value), state_of.isin(NO_UPDATE_EXPECTED, NOT_YET_RELEASED).cast("double").alias(flag))
        return FeatureFrame(x, [entry(value, group_path("macro", "carry", {"col": col}), "macro", "carry", table, col), entry(flag, group_path("macro", "missing_structural", {"col": col}), "macro", "missing_structural", table, col)], labels="session")


class NextSquaredReturn(Template):
    """Target: the square of the next row's log return."""

    name = "next_sq_logret"
    param_space = LagReturns.param_space

    def transform(self, ctx: Any, params: dict[str, Any], slice: SliceSpec, state: Any = None) -> TargetFrame:
        price = self.value(params, "price_col")
        panel = ctx.fetch_panel(self.value(params, "source"), Query(self.value(params, "table"), [price], slice.start, slice.end, slice.entities, slice.asof, grid=slice.grid))
        return TargetFrame(next_squared_return(panel, price))
