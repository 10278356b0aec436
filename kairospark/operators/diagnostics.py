"""Data quality, importance and leakage reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairospark.operators.align import NOT_YET_RELEASED
from kairospark.operators.panel import KEYS
from kairospark.operators.scans import numbered


def column_report(df: DataFrame, fields: Sequence[str] | None = None, label: str = "field") -> DataFrame:
    """A row for each field: n, missing, missing_pct, mean and std (sample; NULL for non-numeric fields). One pass, one partial aggregate."""
    kinds = dict(df.dtypes)
    names = list(fields or [c for c in df.columns if c not in KEYS])
    aggs, rows = [], []
    for k, f in enumerate(names):
        col = F.col(f"`{f}`")
        numeric = kinds[f].split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
        present = F.when(~F.isnan(col), col) if kinds[f] in ("double", "float") else col
        aggs += [F.count("*").alias(f"n{k}"), F.count(present).alias(f"c{k}"), (F.avg(present.cast("double")) if numeric else F.lit(None).cast("double")).alias(f"m{k}"), (F.stddev_samp(present.cast("double")) if numeric else F.lit(None).cast("double")).alias(f"s{k}")]
        missing = F.col(f"n{k}") - F.col(f"c{k}")
        rows.append(F.struct(F.lit(f).alias(label), F.col(f"n{k}").alias("n"), missing.alias("missing"), F.when(F.col(f"n{k}") > 0, missing / F.col(f"n{k}")).alias("missing_pct"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("std")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_quality(x: DataFrame) -> DataFrame:
    return column_report(x, label="feature_id").select("feature_id", "missing_pct", "mean", "std")


def fingerprints(x: DataFrame) -> DataFrame:
    return column_report(x, label="feature_id").select("feature_id", "mean", "std", "missing_pct")


def attach_importance(catalog: DataFrame, importance: DataFrame, col: str = "importance") -> DataFrame:
    """The catalog with each feature's importance, NULL where there is none."""
    return catalog.drop(col).join(importance.select("feature_id", F.col(col).cast("double").alias(col)), "feature_id", "left")


def _aggregated(catalog: DataFrame, by: Sequence[str], col: str, agg: str | Callable[[Column], Column]) -> DataFrame:
    named = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "prod": F.product}
    f = agg if callable(agg) else named[agg] if agg in named else getattr(F, agg)
    keys = [F.col(f"`{c}`") for c in by]
    return catalog.groupBy(*keys).agg(f(F.col(f"`{col}`")).alias(col)).orderBy(F.desc_nulls_last(col), *keys)


def importance_by_data(catalog: DataFrame, by: Sequence[str] = ("source_table", "source_col"), col: str = "importance", agg: str | Callable[[Column], Column] = "sum") -> DataFrame:
    """Importance by data fields, largest first; missing fields are a group. agg: a name (sum, mean, std, var, nunique, prod, or any aggregate of pyspark.sql.functions) or a function of the column."""
    return _aggregated(catalog, by, col, agg)


def importance_by_tag(catalog: DataFrame, tag: str, *, col: str = "importance", tags_col: str = "tags_json", agg: str | Callable[[Column], Column] = "sum") -> DataFrame:
    """Importance by a tag, from a map or JSON column; rows without the tag or with broken JSON are left out."""
    tags = F.col(tags_col)
    value = (tags if dict(catalog.dtypes)[tags_col].startswith("map") else F.from_json(tags, "map<string,string>"))[tag]  # by name: a dot in it is no path
    return _aggregated(catalog.withColumn(tag, value).where(F.col(f"`{tag}`").isNotNull()), [tag], col, agg)


def leakage_audit(aligned: DataFrame) -> DataFrame:
    """n_not_yet_released: the non-missing cells whose availability says that they weren't released. Values carried from earlier observations, which the cell's own observed column tells, are none."""
    fields = [c.removesuffix("__availability") for c in aligned.columns if c.endswith("__availability")]
    shown = lambda f: F.col(f"`{f}__observed`") if f"{f}__observed" in aligned.columns else F.lit(True)
    cells = [F.count_if(F.col(f"`{f}`").isNotNull() & shown(f) & (F.col(f"`{f}__availability`") == NOT_YET_RELEASED)) for f in fields]
    return aligned.agg(sum(cells[1:], cells[0]).alias("n_not_yet_released"))


def future_rows(df: DataFrame, asof_col: str = "asof_utc", ts_col: str = "ts_utc") -> DataFrame:
    """Rows whose time is after what was known."""
    return df.where(F.col(ts_col) > F.col(asof_col))


def assert_no_future_data(df: DataFrame, asof_col: str = "asof_utc", ts_col: str = "ts_utc") -> None:
    kinds = dict(df.dtypes)
    for c in (asof_col, ts_col):
        assert kinds[c] in ("timestamp", "timestamp_ntz"), f"{c} is no time"
    assert future_rows(df, asof_col, ts_col).isEmpty(), "data from after its as-of time"


def grid_faults(grid: DataFrame, order_col: str) -> DataFrame:
    """Rows of a grid, in the order of order_col, that aren't later than the row before. Each row meets the one before by its position; no task has the whole grid."""
    rows, _ = numbered(grid, order_col, "__i")
    before = rows.select((F.col("__i") + 1).alias("__i"), F.col("ts_utc").alias("before"))
    return rows.join(before, "__i").drop("__i").where(F.col("ts_utc") <= F.col("before"))


def assert_grid_is_monotone(grid: DataFrame, order_col: str) -> None:
    assert grid_faults(grid, order_col).isEmpty(), "the grid isn't strictly increasing"
