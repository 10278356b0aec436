"""Time and missing-value coercion: all times are TIMESTAMP_NTZ in UTC, missing is NULL."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def utc(x: Any) -> datetime | None:
    """A scalar as naive UTC: naive is taken as UTC, aware is converted. None stays."""
    if x is None:
        return None
    if isinstance(x, str):
        x = datetime.fromisoformat(x)
    elif isinstance(x, date) and not isinstance(x, datetime):
        x = datetime(x.year, x.month, x.day)
    elif hasattr(x, "to_pydatetime"):
        x = x.to_pydatetime()
    return x.astimezone(timezone.utc).replace(tzinfo=None) if x.tzinfo else x


def at(x: Any) -> Column:
    """A scalar time as a literal TIMESTAMP_NTZ."""
    moment = utc(x)
    return F.lit(None if moment is None else moment.isoformat(sep=" ")).cast("timestamp_ntz")


def to_utc(df: DataFrame, name: str) -> Column:
    """A column as naive UTC, whatever it is: instants are converted, naive times, dates and strings without offset are taken as UTC."""
    kind, col = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    if kind == "string":
        aware = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(col).cast("timestamp_ntz"))
        return F.when(col.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & col.contains(":"), aware).otherwise(col.cast("timestamp_ntz"))
    return col.cast("timestamp_ntz")


def known(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """NaN as NULL in all floating-point columns, so that IS NOT NULL means present."""
    floats = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and f.name not in keys}
    return df.withColumns(floats) if floats else df


@F.arrow_udf(DoubleType())
def _libm_ln(x: pa.Array) -> pa.Array:
    return pc.ln(x)


def log(col: Column) -> Column:
    """Natural logarithm with log(0) as minus infinity and NULL below 0.

    Of the C library, as in NumPy, Python and DuckDB: Spark's own ln, the JVM's StrictMath, differs from it by a unit in the last place for one value in 36, which now and then shows in a rounded return.
    """
    return F.when(col >= 0, _libm_ln(col.cast("double")))


def finite_difference(now: Column, before: Column) -> Column:
    """now - before; the difference of two equal infinities is missing."""
    d = now - before
    return F.when(~F.isnan(d), d)


def interval(delta: timedelta) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delta.total_seconds()).cast("decimal(18,6)"))
