"""Ordered scans of groups of any size: within ranges of time first, then carried from range to range.

A window by a key alone puts a key's rows into one task. With a `segment` of time, windows go by key and segment, what each segment hands on is one row, those few rows are scanned by key, and the result goes back by an equi-join on key and segment, which needs no further shuffle of the rows. Rows are the same either way. The input is read twice with a segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairospark.scratch import scratch

_SEGMENT = "__segment"


def segment_of(time: Column, segment: timedelta) -> Column:
    """The number of the range of that length that a time is in; the session's time zone plays no part."""
    seconds = F.unix_date(time.cast("date")).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.floor(seconds / F.lit(int(segment.total_seconds())))


def _order(time: str, ties: Sequence[str], backward: bool) -> list[Column]:
    return [F.desc(c) if backward else F.asc(c) for c in (time, *ties)]


def _from_others(df: DataFrame, key: str, carried: DataFrame) -> DataFrame:
    facts = carried.withColumnsRenamed({key: "__key", _SEGMENT: "__of"})
    return df.join(facts, df[key].eqNullSafe(facts["__key"]) & (df[_SEGMENT] == facts["__of"]), "left").drop("__key", "__of")


def scanned(df: DataFrame, last: Mapping[str, Column] | None = None, greatest: Mapping[str, Column] | None = None, count: str | None = None, *, key: str = "entity_id", time: str = "ts_utc", ties: Sequence[str] = (), segment: timedelta | None = None, backward: bool = False) -> DataFrame:
    """df with, for each row in order of time and ties within its key, the last known (non-NULL) value of some expressions, the greatest so far of others, and the number of rows so far, itself included. backward: seen from the end. A row without a time comes first (backward: last)."""
    last, greatest = dict(last or {}), dict(greatest or {})
    keys = [key] if segment is None else [key, _SEGMENT]
    own = df if segment is None else df.withColumn(_SEGMENT, F.coalesce(segment_of(F.col(time), segment), F.lit(-(1 << 40))))
    w = Window.partitionBy(*keys).orderBy(*_order(time, ties, backward))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()} | {n: F.max(c).over(upto) for n, c in greatest.items()}
    if count:
        made[count] = F.row_number().over(w).cast("long")
    out = own.withColumns(made)
    if segment is None:
        return out
    place = F.struct(F.col(time), *ties)
    pick = F.min_by if backward else F.max_by
    aggs = [pick(c, F.when(c.isNotNull(), place)).alias(f"__carried_{n}") for n, c in last.items()] + [F.max(c).alias(f"__carried_{n}") for n, c in greatest.items()] + ([F.count("*").alias(f"__carried_{count}")] if count else [])
    before = Window.partitionBy(key).orderBy(F.desc(_SEGMENT) if backward else F.asc(_SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.last(f"__carried_{n}", ignorenulls=True).over(before).alias(f"__carried_{n}") for n in last] + [F.max(f"__carried_{n}").over(before).alias(f"__carried_{n}") for n in greatest] + ([F.sum(f"__carried_{count}").over(before).alias(f"__carried_{count}")] if count else [])
    out = _from_others(out, key, own.groupBy(*keys).agg(*aggs).select(*keys, *handed))
    settled = {n: F.coalesce(n, f"__carried_{n}") for n in last} | {n: F.greatest(n, f"__carried_{n}") for n in greatest} | ({count: F.col(count) + F.coalesce(f"__carried_{count}", F.lit(0))} if count else {})
    return out.withColumns(settled).drop(_SEGMENT, *(f"__carried_{n}" for n in settled))


def shifted(df: DataFrame, what: Mapping[str, tuple[Column, int]], *, key: str = "entity_id", time: str = "ts_utc", ties: Sequence[str] = (), segment: timedelta | None = None) -> DataFrame:
    """df with, for each name, an expression's value so many rows earlier within the key (negative: later), NULL where there is none.

    With a segment, each hands on its last rows (as many as the longest lag) or first ones, so a segment may have fewer rows than a lag is long.
    """
    w = Window.partitionBy(key).orderBy(*_order(time, ties, False))
    if segment is None:
        return df.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in what.items()})
    own = df.withColumn(_SEGMENT, F.coalesce(segment_of(F.col(time), segment), F.lit(-(1 << 40))))
    w = Window.partitionBy(key, _SEGMENT).orderBy(*_order(time, ties, False))
    out = own.withColumns({f"__at_{n}": F.lag(c, k).over(w) for n, (c, k) in what.items()})
    for back, sign in ((False, 1), (True, -1)):
        longest = max((sign * k for _, k in what.values()), default=0)
        if longest <= 0:
            continue
        mine = {n: (c, sign * k) for n, (c, k) in what.items() if sign * k > 0}
        ranked = own.select(key, _SEGMENT, *(c.alias(f"__v_{n}") for n, (c, _) in mine.items()), F.row_number().over(Window.partitionBy(key, _SEGMENT).orderBy(*_order(time, ties, not back))).alias("__r"))
        # The rows nearest to the boundary, the nearest first: a few for each segment.
        edge = ranked.where(F.col("__r") <= longest).groupBy(key, _SEGMENT).agg(F.sort_array(F.collect_list(F.struct("__r", *(f"__v_{n}" for n in mine)))).alias("__edge"))
        others = Window.partitionBy(key).orderBy(F.desc(_SEGMENT) if back else F.asc(_SEGMENT)).rowsBetween(-longest, -1)
        near = F.slice(F.flatten(F.reverse(F.collect_list("__edge").over(others))), 1, longest)
        out = _from_others(out.withColumn("__n", F.row_number().over(Window.partitionBy(key, _SEGMENT).orderBy(*_order(time, ties, back)))), key, edge.select(key, _SEGMENT, near.alias("__near")))
        for n, (_, k) in mine.items():
            out = out.withColumn(f"__at_{n}", F.when(F.col("__n") > k, F.col(f"__at_{n}")).otherwise(F.get("__near", F.lit(k) - F.col("__n"))[f"__v_{n}"]))
        out = out.drop("__n", "__near")
    return out.drop(_SEGMENT).withColumns({n: F.col(f"__at_{n}") for n in what}).drop(*(f"__at_{n}" for n in what))


def numbered(values: DataFrame, column: str, name: str = "i", parts: int | None = None) -> tuple[DataFrame, int]:
    """values with each row's position from 0 in the order of a column, and the number of rows; NULL first.

    The rows are dealt out by ranges and written in order; positions are those within a part plus the counts of the parts before it, which are as many numbers as parts. No task has all rows, and the table is written once so that ranges don't change between reads.
    """
    spark = values.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark)
    values.repartitionByRange(n, F.asc_nulls_first(column)).sortWithinPartitions(F.asc_nulls_first(column)).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(values.withColumn("__id", F.lit(0).cast("long")).schema).parquet(path).withColumn("__part", F.shiftright("__id", 33))
    total, first = 0, []
    for part, size in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        first.append((part, total))
        total += size
    offsets = F.broadcast(spark.createDataFrame(first, "__part long, __first long"))
    return rows.join(offsets, "__part").withColumn(name, F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__first"), total


def neighbours(positions: DataFrame, name: str, roles: Mapping[str, tuple[str, int]], keep: Column | None = None) -> DataFrame:
    """(position, role columns): for each position the columns' values at positions so far off, by one aggregation on the position. roles: name -> (column, offset). keep: a condition on the position."""
    sent = F.array(*(F.struct((F.col(name) - off).alias("at"), F.lit(r).alias("role"), *(F.col(c).alias("value") for c in (column,))) for r, (column, off) in roles.items()))
    met = positions.select(F.explode(sent).alias("x")).select(F.col("x.at").alias(name), "x.role", "x.value").where(F.col(name) >= 0)
    met = met if keep is None else met.where(keep)
    return met.groupBy(name).agg(*(F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in roles))
