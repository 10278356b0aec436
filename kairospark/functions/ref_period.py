"""Reference periods: years, quarters and months, as scalars and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairospark.functions.times import utc


@dataclass(frozen=True)
class RefPeriod:
    freq: str  # A, Q or M
    year: int
    period: int = 1

    @staticmethod
    def parse(text: str) -> RefPeriod:
        """YYYY, YYYYQq, YYYY-MM, YYYY/MM, or a month's last day as YYYY-MM-DD."""
        s = text.strip().upper()
        if re.fullmatch(r"\d{4}", s):
            return RefPeriod("A", int(s))
        if m := re.fullmatch(r"(\d{4})Q([1-4])", s):
            return RefPeriod("Q", int(m[1]), int(m[2]))
        if m := re.fullmatch(r"(\d{4})[-/](0[1-9]|1[0-2])", s):
            return RefPeriod("M", int(m[1]), int(m[2]))
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
            day = date.fromisoformat(s)
            if (day + timedelta(days=1)).day == 1:
                return RefPeriod("M", day.year, day.month)
        raise ValueError(f"not a reference period: {text!r}")

    def key(self) -> str:
        return {"A": f"{self.year:04d}", "Q": f"{self.year:04d}Q{self.period}", "M": f"{self.year:04d}-{self.period:02d}"}[self.freq]

    def end(self) -> datetime:
        """Midnight of the period's last day."""
        month = {"A": 12, "Q": 3 * self.period, "M": self.period}[self.freq]
        return datetime(self.year + month // 12, month % 12 + 1, 1) - timedelta(days=1)

    @staticmethod
    def of_end(ts: Any, freq: str) -> RefPeriod:
        """The period that ends on the day of ts."""
        day = utc(ts)
        period = {"A": 1, "Q": (day.month + 2) // 3, "M": day.month}[freq]
        out = RefPeriod(freq, day.year, period)
        if out.end().date() != day.date():
            raise ValueError(f"{day.date()} ends no period of frequency {freq}")
        return out


def parsed(text: Column) -> Column:
    """Struct (freq, year, period) of each text, NULL where it is no period."""
    s = F.upper(F.trim(text))
    day = F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")
    whole = lambda p, g: F.regexp_extract(s, p, g).cast("int")

    def made(freq: str, year: Column, period: Column) -> Column:
        return F.struct(F.lit(freq).alias("freq"), year.alias("year"), period.alias("period"))

    return (
        F.when(s.rlike(r"^\d{4}$"), made("A", whole(r"^(\d{4})", 1), F.lit(1)))
        .when(s.rlike(r"^\d{4}Q[1-4]$"), made("Q", whole(r"^(\d{4})", 1), whole(r"Q([1-4])$", 1)))
        .when(s.rlike(r"^\d{4}[-/](0[1-9]|1[0-2])$"), made("M", whole(r"^(\d{4})", 1), whole(r"(\d{2})$", 1)))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & (day == F.last_day(day)), made("M", F.year(day), F.month(day)))
    )


def key(period: Column) -> Column:
    year = F.lpad(period["year"].cast("string"), 4, "0")
    return F.when(period["freq"] == "A", year).when(period["freq"] == "Q", F.concat(year, F.lit("Q"), period["period"].cast("string"))).when(period["freq"] == "M", F.concat(year, F.lit("-"), F.lpad(period["period"].cast("string"), 2, "0")))


def end(period: Column) -> Column:
    month = F.when(period["freq"] == "A", 12).when(period["freq"] == "Q", 3 * period["period"]).otherwise(period["period"])
    return F.last_day(F.make_date(period["year"], month, F.lit(1))).cast("timestamp_ntz")


def of_end(ts: Column, freq: str) -> Column:
    """The period of that frequency that ends on the day of ts, else NULL."""
    day = ts.cast("date")
    period = {"A": F.lit(1), "Q": F.quarter(day), "M": F.month(day)}[freq]
    out = F.struct(F.lit(freq).alias("freq"), F.year(day).alias("year"), period.alias("period"))
    return F.when(end(out).cast("date") == day, out)


def ref_entity_id(series_key: Column, ref_key: Column) -> Column:
    return F.concat_ws("|", series_key, ref_key)


def split_ref_entity_id(entity: Column) -> Column:
    """Struct (series_key, ref_key), cut at the first bar; NULL where a part is empty or missing."""
    parts = F.split(entity, r"\|", 2)
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.length(one) > 0) & (F.length(two) > 0), F.struct(one.alias("series_key"), two.alias("ref_key")))


def make_ref_entity_id(series_key: str, ref_key: str) -> str:
    if not series_key or not ref_key:
        raise ValueError("both parts are needed")
    return f"{series_key}|{ref_key}"


def parse_ref_entity_id(entity: str) -> tuple[str, str]:
    one, bar, two = entity.partition("|")
    if not (one and bar and two):
        raise ValueError(f"not a reference entity: {entity!r}")
    return one, two
