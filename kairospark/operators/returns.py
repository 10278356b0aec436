"""Lags, leads and log returns for each entity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairospark.functions.times import finite_difference, log
from kairospark.operators.scans import shifted

# segment: rows of a key are scanned by ranges of time of that length, so that no task has all rows of a hot entity.


def log_returns(panel: DataFrame, price: str, out: str = "logret", *, segment: timedelta | None = None) -> DataFrame:
    """ts_utc, entity_id and the change of the log price against the entity's row before."""
    x = log(F.col(f"`{price}`"))
    both = shifted(panel.select("ts_utc", "entity_id", x.alias("__x")), {"__before": (F.col("__x"), 1)}, segment=segment)
    return both.select("ts_utc", "entity_id", finite_difference(F.col("__x"), F.col("__before")).alias(out))


def lagged(panel: DataFrame, column: str, lags: Sequence[int], name=lambda k: f"lag_{k}", *, segment: timedelta | None = None) -> DataFrame:
    """One column for each lag in rows; negative lags look ahead. All share one sort."""
    own = panel.select("ts_utc", "entity_id", F.col(f"`{column}`").alias("__x"))
    made = shifted(own, {f"__{i}": (F.col("__x"), k) for i, k in enumerate(lags)}, segment=segment)
    return made.select("ts_utc", "entity_id", *(F.col(f"__{i}").alias(name(k)) for i, k in enumerate(lags)))


def next_squared_return(panel: DataFrame, price: str, out: str = "y", *, segment: timedelta | None = None) -> DataFrame:
    """The square of the entity's next log return."""
    r = log_returns(panel, price, "__r", segment=segment)
    return shifted(r, {"__next": (F.col("__r"), -1)}, segment=segment).select("ts_utc", "entity_id", F.pow("__next", 2).alias(out))
