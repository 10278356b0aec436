"""The panel engine on small fixtures with known answers."""

import pickle
import random
import warnings
from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairospark.functions import ref_period as ref
from kairospark.functions.calendars import EventGrid, FixedIntervalEvents, SessionCloseEvents, TradingCalendar, build_grid
from kairospark.functions.times import utc
from kairospark.operators import diagnostics as diag
from kairospark.operators import pit
from kairospark.operators.align import AlignSpec, align_panel
from kairospark.operators.joins import first_catalog, join_frames, next_in_grid
from kairospark.operators.panel import from_long, sliced, unique
from kairospark.operators.splits import _moved, expanding_splits, purged_kfold, rolling_splits
from kairospark.operators.universe import entities_on, from_wide, restricted, spells
from kairospark.plans.dataset import build_dataset, join_feature_frames
from kairospark.plans.ids import feature_id, feature_id_column, group_path
from kairospark.plans.specs import DatasetSpec, FeatureFrame, FeatureRealization, FeatureRequest, FeatureTemplate, JoinPolicy, MissingnessPolicy, ParamSpec, SliceOverride, SliceSpec, TargetFrame, TargetRequest, TimeSpec, UniverseSpec
from kairospark.plans.store import LineageGraph, MaterializationPolicy, ParquetStore, RawCache, materialize
from kairospark.plans.templates import CalendarFlags, LagReturns, MacroCarry, NextSquaredReturn
from kairospark.queries import ORACLES, QUERIES
from kairospark.sources.catalog import FrameSource, Query, SeriesSource, TableSchema
from kairospark.sources.context import DataContext
from kairospark.streaming.pit_ingest import stream_into

NY = TradingCalendar()


def day(text):
    return datetime.fromisoformat(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ctx(spark):
    rng = random.Random(0)
    days = [d.to_pydatetime() for d in pd.bdate_range("2020-01-01", "2020-03-31")]
    price = {"AAA": 100.0, "BBB": 50.0}
    bars = []
    for d in days:
        for e in price:
            price[e] += rng.uniform(-1, 1)
            bars.append((d, e, price[e]))
    macro = [(day("2020-01-31"), "CPI", 1.0), (day("2020-02-29"), "CPI", 2.0), (day("2020-03-31"), "CPI", 3.0)]
    tables = {"market.ohlcv": spark.createDataFrame(bars, "date timestamp_ntz, entity_id string, close double"), "macro.series": spark.createDataFrame(macro, "date timestamp_ntz, entity_id string, value double")}
    schemas = {"market.ohlcv": TableSchema("market.ohlcv", native_freq="B", expected_cadence_days=1), "macro.series": TableSchema("macro.series", native_freq="M", expected_cadence_days=30)}
    return DataContext(spark, {"src": FrameSource("src", tables, schemas)}, {"XNYS": NY, "UTC": TradingCalendar("UTC", "UTC")})


# ---- time ----------------------------------------------------------------------------------------------------------
def test_utc_coercion(spark):
    assert utc("2021-01-01 10:00") == utc(datetime(2021, 1, 1, 11, tzinfo=timezone(timedelta(hours=1)))) == datetime(2021, 1, 1, 10)
    df = spark.createDataFrame([("2021-01-01 10:00:00",), ("2021-01-01T12:00:00+02:00",)], "date string").withColumn("entity_id", F.lit(1))
    assert {r.ts_utc for r in from_long(df).collect()} == {datetime(2021, 1, 1, 10)}
    with pytest.raises(ValueError):
        from_long(df, "nope")


@pytest.mark.parametrize(
    "label, tz, compat, want",
    [
        ("2021-01-04", "America/New_York", False, "2021-01-04 21:00"), ("2021-07-06", "America/New_York", False, "2021-07-06 20:00"), ("2021-03-15", "America/New_York", False, "2021-03-15 20:00"), ("2021-11-08", "America/New_York", False, "2021-11-08 21:00"),
        ("2021-01-04", "America/New_York", True, "2021-01-03 21:00"), ("2021-07-06", "America/New_York", True, "2021-07-05 20:00"), ("2021-03-15", "America/New_York", True, "2021-03-14 21:00"), ("2021-11-08", "America/New_York", True, "2021-11-07 20:00"),
        ("2021-01-04", "UTC", False, "2021-01-04 16:00"), ("2021-01-04", "Asia/Tokyo", True, "2021-01-04 07:00"),
    ],
)
def test_session_close(spark, label, tz, compat, want):
    df = spark.createDataFrame([(day(label),)], "l timestamp_ntz")
    assert df.select(TradingCalendar("x", tz, compat).close(F.col("l"))).first()[0] == day(want)


def test_grids(spark):
    ticks = [r[0] for r in build_grid(spark, NY, "2021-01-04", "2021-01-05", "5min").orderBy("ts_utc").collect()]
    assert len(ticks) == 78 and ticks[0] == day("2021-01-04 14:35") and ticks[-1] == day("2021-01-04 21:00")
    assert build_grid(spark, NY, "2021-01-02", "2021-01-03", "B").isEmpty()
    assert build_grid(spark, NY, "2021-01-03", "2021-01-02", "B").isEmpty()
    with pytest.raises(ValueError):
        build_grid(spark, NY, "2021-01-04", "2021-01-05", "hourly")


def test_next_and_previous_session(spark):
    for start, after, before in (("2021-01-01 20:00", "2021-01-04 20:00", "2020-12-31 20:00"), ("2021-01-02 10:00", "2021-01-04 10:00", "2021-01-01 10:00"), ("2021-01-04 00:00", "2021-01-05 00:00", "2021-01-01 00:00")):
        df = spark.createDataFrame([(day(start),)], "t timestamp_ntz")
        assert tuple(df.select(NY.next_session(F.col("t")), NY.prev_session(F.col("t"))).first()) == (day(after), day(before))


def test_ref_periods(spark):
    for text, key, end in (("2024Q4", "2024Q4", "2024-12-31"), ("2025q1", "2025Q1", "2025-03-31"), ("2025-01", "2025-01", "2025-01-31"), ("2025/01", "2025-01", "2025-01-31"), ("2025-01-31", "2025-01", "2025-01-31"), ("2024-02", "2024-02", "2024-02-29"), ("2025", "2025", "2025-12-31")):
        p = ref.RefPeriod.parse(text)
        assert (p.key(), p.end()) == (key, day(end)) and ref.RefPeriod.of_end(p.end(), p.freq) == p
        col = spark.createDataFrame([(text,)], "t string").select(ref.parsed(F.col("t")).alias("p"))
        assert tuple(col.select(ref.key(F.col("p")), ref.end(F.col("p"))).first()) == (key, day(end))
    for bad in ("2025-01-30", "2025-13", "2025Q5", ""):
        with pytest.raises(ValueError):
            ref.RefPeriod.parse(bad)
        assert spark.createDataFrame([(bad,)], "t string").select(ref.parsed(F.col("t"))).first()[0] is None
    with pytest.raises(ValueError):
        ref.RefPeriod.of_end("2025-01-31", "Q")
    assert ref.parse_ref_entity_id(ref.make_ref_entity_id("GDP", "2024Q4")) == ("GDP", "2024Q4")
    for bad in ("GDP", "|x", "x|"):
        with pytest.raises(ValueError):
            ref.parse_ref_entity_id(bad)


# ---- panels --------------------------------------------------------------------------------------------------------
def test_slice_and_asof(spark):
    data = [(day(f"2021-01-01 15:{m}"), "A", v) for m, v in ((30, 1), (35, 2), (40, 3))]
    df = spark.createDataFrame(data, "date timestamp_ntz, entity_id string, v int")
    assert sliced(from_long(df), "2021-01-01 15:35", "2021-01-01 15:40").count() == 2
    c = DataContext(spark, {"s": FrameSource("s", {"t": df}, {})})
    got = c.fetch_panel("s", Query("t", asof="2021-01-01 15:37")).collect()
    assert [r.v for r in got] == [1, 2] and got[0].asof_utc == day("2021-01-01 15:37")


def test_label_mapping_and_bounds(ctx):
    q = Query("market.ohlcv", ["close"], "2020-01-06", "2020-01-10", ["AAA"])
    assert ctx.fetch_panel("src", q).count() == 4  # the close of the last day is after its midnight
    assert ctx.fetch_panel("src", q, whole_last_session=True).count() == 5


def test_universe(spark):
    wide = spark.createDataFrame([(day("2020-01-01"), True, None), (day("2020-02-01"), False, True)], "date timestamp_ntz, A boolean, B boolean")
    u = from_wide(wide)
    panel = spark.createDataFrame([(day(d), e) for d in ("2019-12-31", "2020-01-15", "2020-02-01", "2020-05-01") for e in "AB"], "ts_utc timestamp_ntz, entity_id string")
    assert rows(restricted(panel, u)) == [(day("2020-01-15"), "A"), (day("2020-02-01"), "B"), (day("2020-05-01"), "B")]
    assert rows(entities_on(u, "2020-01-20")) == [("A",)] and entities_on(u, "2019-01-01").isEmpty()


def test_spells_join_up(spark):
    u = spark.createDataFrame([(day(f"2020-0{k}-01"), "A", k != 3) for k in range(1, 6)] + [(day("2020-02-01"), "B", True)], "date timestamp_ntz, entity_id string, is_member boolean")
    assert rows(spells(u).select("entity_id", "since", "until")) == [("A", day("2020-01-01"), day("2020-03-01")), ("A", day("2020-04-01"), None), ("B", day("2020-02-01"), day("2020-03-01"))]


def test_raw_cache(spark, tmp_path):
    cache = RawCache(spark, f"file://{tmp_path}")
    assert cache.get("k") is None
    for n in (3, 5):
        cache.set("k", spark.range(n))
    assert cache.get("k").count() == 5 and cache.index().select("name", "kind", "n_rows").collect() == [("k", "raw", 5)]
    for part in tmp_path.glob("*/part-*"):
        part.write_bytes(b"no table")
    for mark in tmp_path.glob("*/.part-*.crc"):
        mark.unlink()
    assert cache.get("k") is None


def test_series_source(spark):
    s = SeriesSource(spark, "web", "t", lambda name, start, end, asof: [("2020-01-01", len(name)), ("2020-02-01", 2.5)])
    got = s.fetch(Query("t", entities=["A", "BB"], asof="2020-03-01 12:00"))
    assert rows(got.select("series_id", "value")) == [("A", 1.0), ("A", 2.5), ("BB", 2.0), ("BB", 2.5)]
    assert {r.asof_utc for r in got.collect()} == {day("2020-03-01")}
    with pytest.raises(ValueError):
        s.fetch(Query("t"))


@pytest.mark.parametrize("method, limit, want", [("ffill", None, [None, 1, 1, 1, 4, 4]), ("step_hold", 1, [None, 1, 1, None, 4, 4]), ("interp", None, [1, 1, 2, 3, 4, 4]), ("none", None, [None, 1, None, None, 4, None])])
def test_fills(spark, method, limit, want):
    days = [d.to_pydatetime() for d in pd.bdate_range("2020-01-06", periods=6)]
    grid = spark.createDataFrame([(d,) for d in days], "ts_utc timestamp_ntz")
    panel = spark.createDataFrame([(days[1], "A", 1.0), (days[4], "A", 4.0)], "ts_utc timestamp_ntz, entity_id string, v double")
    out = align_panel(panel, grid, TableSchema(native_freq="B"), AlignSpec(method, limit)).orderBy("ts_utc").collect()
    assert [r.v for r in out] == want
    assert [r.v__observed for r in out] == [False, True, False, False, True, False]
    with pytest.raises(ValueError):
        align_panel(panel.union(panel), grid, TableSchema(), AlignSpec())
    with pytest.raises(ValueError):
        align_panel(panel, grid, TableSchema(), AlignSpec("guess"))


def test_macro_alignment(ctx):
    grid = NY.sessions(ctx.spark, "2020-01-01", "2020-03-31").withColumnRenamed("session", "ts_utc")
    panel = ctx.fetch_panel("src", Query("macro.series", ["value"]))
    out = {r.ts_utc: r for r in align_panel(panel, grid, ctx.schema("src", "macro.series"), fields=["value"]).collect()}
    assert out[day("2020-02-14")].value__availability == "no_update_expected" and out[day("2020-02-14")].value == 1.0
    assert 2.0 not in {r.value for r in out.values()}  # that day is a Saturday
    late = {r.ts_utc: r.value for r in align_panel(panel, grid, ctx.schema("src", "macro.series"), AlignSpec(match="asof"), fields=["value"]).collect()}
    assert late[day("2020-03-02")] == 2.0


def test_joins(spark):
    key = "ts_utc timestamp_ntz, entity_id string, "
    a, b = (spark.createDataFrame([(day("2020-01-01"), "A", 1.0), (day(d), "A", 2.0)], key + f"{n} double") for n, d in (("a", "2020-01-02"), ("b", "2020-01-03")))
    assert join_frames([a, b]).count() == 1 and join_frames([a, b], "outer").count() == 3
    for bad in (lambda: join_frames([]), lambda: join_frames([a, b], "left"), lambda: join_frames([a, a]), lambda: unique(a.union(a))):
        with pytest.raises(ValueError):
            bad()
    cat = [spark.createDataFrame([("f", k)], "feature_id string, source string") for k in ("first", "second")]
    assert [r.source for r in first_catalog(cat).collect()] == ["first"]
    joined = join_feature_frames([FeatureFrame(a, [{"feature_id": "a"}]), FeatureFrame(b, [{"feature_id": "b"}, {"feature_id": "a", "x": 1}])])
    assert joined.features == ["a", "b"] and joined.catalog == [{"feature_id": "a"}, {"feature_id": "b"}]


def test_next_in_grid(spark):
    rng = random.Random(1)
    grid = sorted({day("2020-01-01") + timedelta(hours=rng.randrange(3000)) for _ in range(60)})
    asked = [day("2020-01-01") + timedelta(hours=rng.randrange(3200)) for _ in range(200)] + grid[:5] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k long, ts_utc timestamp_ntz")
    got = {r.k: r.target_end for r in next_in_grid(df, spark.createDataFrame([(g,) for g in grid], "ts_utc timestamp_ntz")).collect()}
    assert got == {k: next((g for g in grid if t and g > t), None) for k, t in enumerate(asked)}


# ---- bitemporal ----------------------------------------------------------------------------------------------------
# Observations whose snapshots are known.
GDP = [("GDP", "2024-12-31", "2025-01-10", 1.0), ("GDP", "2024-12-31", "2025-02-10", 1.1), ("GDP", "2025-03-31", "2025-04-10", 2.0), ("GDP", "2025-03-31", "2025-05-10", 2.1), ("CPI", "2024-12-31", "2025-01-20", 5.0)]


def test_pit(spark, tmp_path):
    t = pit.PitTable(spark, f"file://{tmp_path}/pit")
    df = spark.createDataFrame([(k, day(o), day(a), v) for k, o, a, v in GDP], "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double")
    assert t.read().isEmpty()
    t.upsert(df)
    t.upsert(df)
    p = t.read()
    assert p.count() == 5
    value = lambda asof, **how: [r.value for r in pit.snapshot(p, asof, series_key="GDP", **how).orderBy("obs_date").collect()]
    assert value("2025-01-15") == [1.0] and value("2025-03-01") == [1.1]
    assert value("2025-06-01", start="2025-03-31", end="2025-03-31") == [2.1]
    assert [r.value for r in pit.timeline(p, "2024-12-31", series_key="GDP").collect()] == [1.0, 1.1]
    assert [r.value for r in pit.timeline_ref(p, "2024Q4", series_key="GDP", freq="Q").collect()] == [1.0, 1.1]
    assert [r.value for r in pit.snapshot_ref(p, "2025-06-01", "2025Q1", "2025Q1", series_key="GDP").collect()] == [2.1]
    t.upsert(df.limit(0).union(spark.createDataFrame([("CPI", day("2024-12-31"), day("2025-02-01"), None)], df.schema)))
    assert pit.snapshot(t.read(), "2025-03-01", series_key="CPI").first().value is None  # a missing latest value hides older ones
    for bad in (lambda: t.upsert(df.union(df)), lambda: t.upsert(df.drop("value")), lambda: t.upsert(df.withColumn("series_key", F.lit(None).cast("string"))), lambda: pit.snapshot(p, "2025-01-01", method="x"), lambda: pit.period_end("2025-01", "Q")):
        with pytest.raises(ValueError):
            bad()


def test_streaming_ingest(spark, tmp_path):
    source, t = f"file://{tmp_path}/in", pit.PitTable(spark, f"file://{tmp_path}/pit")
    df = spark.createDataFrame([(k, day(o), day(a), v) for k, o, a, v in GDP], "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double")
    df.union(df).write.parquet(source)
    for _ in range(2):
        stream_into(spark.readStream.schema(df.schema).parquet(source), t, f"file://{tmp_path}/check").awaitTermination(120)
    assert t.read().count() == 5


def test_the_log_of_vintages(spark, tmp_path):
    root = f"{tmp_path}/pit"
    t = pit.PitTable(spark, f"file://{root}", most_parts=3)
    df = lambda n, v: spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("series_key"), F.lit(day("2024-12-31")).alias("obs_date"), F.lit(day("2025-01-01")).alias("asof_utc"), F.lit(float(v)).alias("value"))

    def size():
        return {p.name: sum(f.stat().st_size for f in p.iterdir()) for p in Path(f"{root}/parts").iterdir()}

    t.upsert(df(200_000, 1))
    first = size()
    t.upsert(df(3, 2))
    assert len(size()) == 2 and sum(size().values()) - sum(first.values()) < sum(first.values()) / 20  # the batch's rows, not the table's
    assert t.read().count() == 200_000 and t.read().where("value = 2").count() == 3
    with pytest.raises(ValueError):
        t.upsert(df(3, 3).union(df(3, 3)))
    assert len(size()) == 2  # a refused batch is removed
    for v in (4, 5, 6):
        t.upsert(df(v, v))
    assert len(size()) <= 4  # one part, and those that the manifest before names
    assert sorted(r.value for r in t.read().where("value > 1").collect()) == [6.0] * 6
    other = pit.PitTable(spark, f"file://{root}")
    assert other.read().count() == 200_000


def test_protocols_and_tags_with_dots(spark):
    assert isinstance(LagReturns(), FeatureTemplate) and isinstance(NextSquaredReturn(), FeatureTemplate) and not isinstance(object(), FeatureTemplate)
    cat = spark.createDataFrame([("f1", '{"a.b": "x", "a": {"b": "y"}}'), ("f2", '{"a": {"b": "z"}}')], "feature_id string, tags_json string").withColumn("importance", F.lit(2.0))
    [r] = diag.importance_by_tag(cat, "a.b", agg="nunique").collect()
    assert tuple(r) == ("x", 1)
    assert diag.importance_by_data(cat, ("feature_id",), agg="stddev_pop").count() == 2


# ---- identities, datasets, stores ----------------------------------------------------------------------------------
def test_feature_ids_as_expressions(spark):
    """The same ids as one by one, for keys of any printable ASCII."""
    keys = ["AAA", "", "a b", 'q"uo\\te/', "tab\tline\n", "".join(map(chr, range(32, 127)))]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "key string")
    got = {r.key: r.id for r in df.select("key", feature_id_column("t", F.col("key"), "lag", "logret", {"k": 3, "a": [1, None]}).alias("id")).collect()}
    assert got == {k: feature_id("t", k, "lag", "logret", {"k": 3, "a": [1, None]}) for k in keys} | {None: None}
    for bad in ("é", "a\x0b"):
        with pytest.raises(Exception, match="not a printable ASCII key"):
            spark.createDataFrame([(bad,)], "key string").select(feature_id_column("t", F.col("key"), "lag", "logret", {})).collect()


def test_sorted_dataset(ctx, tmp_path):
    lag = {"source": "src", "table": "market.ohlcv", "price_col": "close"}
    for persist in (None, str(tmp_path / "d")):
        spec = DatasetSpec(UniverseSpec(["BBB", "AAA"]), TimeSpec("2020-01-06", "2020-02-28"), TargetRequest(NextSquaredReturn(), lag), [FeatureRequest(LagReturns(), lag | {"lags": 3})], join_policy=JoinPolicy(sort_index=True))
        made = build_dataset(ctx, spec, persist=persist)
        keys = [(r.ts_utc, r.entity_id) for r in made.data.collect()]
        assert keys and keys == sorted(keys) and [r["feature_id"] for r in made.catalog] == sorted(made.features)


def test_series_are_dealt_over_bounded_tasks(spark):
    s = SeriesSource(spark, "web", "t", lambda name, start, end, asof: [("2020-01-01", float(name))], most_tasks=3)
    got = s.fetch(Query("t", entities=[str(k) for k in range(20)], asof="2020-03-01"))
    assert got.rdd.getNumPartitions() == 3 and sorted(r.value for r in got.collect()) == list(range(20))


def test_identities():
    assert feature_id("market.ohlcv", "*", "lag", "logret", {"k": 1}) == "lag.logret.bf32f5a1d1f0"
    assert feature_id("calendar.XNYS", "*", "calendar", "dow", {}) == "calendar.dow.df92d9cbea10"
    assert feature_id("macro.series", "*", "macro", "carry", {"col": "value", "method": "ffill"}) == "macro.carry.c219d7b1fc75"
    assert group_path("lag", "logret", {"k": 1, "other": 2}) == "lag/logret/k=1" and group_path("a", "b", {}) == "a/b"
    s = SliceSpec(pd.Timestamp("2020-01-01"), pd.Timestamp("2020-03-31"), ["AAA", "BBB"], None, "sessions:XNYS")
    assert FeatureRealization("lag_returns", "1.0", {"lags": 5, "source": "dummy", "table": "market.ohlcv", "price_col": "close"}, s).id() == "lag_returns:1.0:a05b198a99aa459e"
    with pytest.raises(ValueError):
        ParamSpec("int", 1, 0, 5).check(9)


class Given:
    """A template that returns what it is given."""

    version = "1.0"
    param_space: dict = {}

    def __init__(self, out, name="given"):
        self.out, self.name, self.calls = out, name, 0

    def fit(self, ctx, params, slice):
        return {"n": 1}

    def transform(self, ctx, params, slice, state):
        self.calls += 1
        return self.out(ctx, slice) if callable(self.out) else self.out


def dataset(ctx, features, target=None, **how):
    policy = MissingnessPolicy(how.pop("policy", "drop_if_any_nan"))
    time = TimeSpec(how.pop("start", "2020-01-01"), how.pop("end", "2020-03-31"), "XNYS", how.pop("grid", "B"), how.pop("asof", None))
    spec = DatasetSpec(UniverseSpec(how.pop("entities", ["AAA", "BBB"])), time, target or TargetRequest(NextSquaredReturn(), {"source": "src"}), features, missingness=policy)
    return build_dataset(ctx, spec, **how)


def test_dataset(ctx, tmp_path):
    made = dataset(ctx, [FeatureRequest(LagReturns(), {"source": "src", "lags": 3}, tags={"kind": "price"}), FeatureRequest(CalendarFlags())], persist=f"file://{tmp_path}/d")
    assert len(made.features) == 5 and made.n_rows() == 2 * (65 - 1 - 3 - 1 - 1)  # the last session's close is after the end
    assert made.catalog[0]["tags"] == {"kind": "price"} and made.x.columns[2:] == made.features
    longer = dataset(ctx, [FeatureRequest(LagReturns(), {"source": "src", "lags": 3}, SliceOverride(lookback=timedelta(days=9)))], start="2020-02-03")
    assert longer.n_rows() == 2 * (pd.bdate_range("2020-02-03", "2020-03-31").size - 2)
    macro = FeatureRequest(MacroCarry(), {"source": "src", "entities": ["CPI"]}, broadcast_entities=True)
    assert dataset(ctx, [macro]).n_rows() > 0 == dataset(ctx, [FeatureRequest(MacroCarry(), {"source": "src", "entities": ["CPI"]})]).n_rows()


def test_dataset_universe_is_the_table(spark, tmp_path):
    # Ids beyond 149 and a null one.
    rows_ = [(k, datetime(2024, 1, d, 12 + h, 5), u, float(1 + (7 * d + 3 * h + u % 11) % 13)) for k, (d, h, u) in enumerate((d, h, u) for d in range(2, 31) for h in range(3, 9) for u in (3, 149, 150, 1499, 70_000))]
    events = spark.createDataFrame([*rows_, (9999, datetime(2024, 1, 9, 15), None, 1.0)], "event_id long, ts timestamp_ntz, user_id long, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("dataset_drop", "dataset_keep", "dataset_intraday"):
        sql = ORACLES[name]
        got = sorted(map(repr, map(tuple, QUERIES[name](spark, f"file://{tmp_path}").select("ts_utc", "entity_id", "lag_1", "lag_2", "target").collect())))
        assert got == sorted(map(repr, duck.execute(f"SELECT ts_utc, entity_id, lag_1, lag_2, target FROM ({sql})").fetchall()))
        assert any("70000" in r for r in got)


def test_entities_of_a_frame_are_those_of_a_list(ctx):
    frame = ctx.spark.createDataFrame([("AAA",), ("BBB",), ("AAA",), (None,)], "entity_id string")
    features = [FeatureRequest(LagReturns(), {"source": "src", "lags": 3}), FeatureRequest(CalendarFlags())]
    assert rows(dataset(ctx, features, entities=frame).data) == rows(dataset(ctx, features).data)
    with pytest.raises(ValueError):
        dataset(ctx, [], entities=frame.limit(0))


def test_dataset_alignment(ctx):
    first = NY.sessions(ctx.spark, "2020-01-01", "2020-01-01")
    x = first.select(F.col("session").alias("ts_utc"), F.lit("AAA").alias("entity_id"), F.lit(1.0).alias("f"))
    y = ctx.spark.createDataFrame([(day("2020-01-01"), 0.1), (day("2020-01-02"), 0.2)], "ts_utc timestamp_ntz, y double")
    made = dataset(ctx, [FeatureRequest(Given(FeatureFrame(x, [{"feature_id": "f"}])))], TargetRequest(Given(TargetFrame(y))))
    assert rows(made.data) == [(day("2020-01-01 21:00"), "AAA", 1.0, 0.1)]
    assert dataset(ctx, [FeatureRequest(Given(FeatureFrame(x, [{"feature_id": "f"}])))], TargetRequest(Given(TargetFrame(y))), policy="keep").n_rows() == 130
    for bad in (lambda: dataset(ctx, [], entities=[]), lambda: dataset(ctx, [], start="2020-01-04", end="2020-01-05"), lambda: dataset(ctx, [], policy="x"), lambda: dataset(ctx, [FeatureRequest(Given(FeatureFrame(x.union(x), [{"feature_id": "f"}])))])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        dataset(ctx, [], TargetRequest(Given(3)))


def test_leak_warning(ctx):
    x = ctx.spark.createDataFrame([(day("2021-01-04 09:30"), "AAA", 10.0), (day("2021-01-04 09:35"), "AAA", 11.0)], "ts_utc timestamp_ntz, entity_id string, close double")
    y = TargetFrame(x.withColumnRenamed("close", "y"))
    request = FeatureRequest(Given(FeatureFrame(x, [{"feature_id": "close"}], labels="instant")))
    grid = EventGrid(x.select("ts_utc"))
    how = {"start": "2021-01-04", "end": "2021-01-05", "grid": grid, "asof": "2021-01-04 09:32", "entities": ["AAA"]}
    with pytest.warns(UserWarning, match="returned 1 rows with timestamps after asof"):
        made = dataset(ctx, [request], TargetRequest(Given(y)), **how)
    assert made.meta["leak_detected"] and made.n_rows() == 2
    assert dataset(ctx, [request], TargetRequest(Given(y)), on_leak="drop", **how).n_rows() == 1
    with pytest.raises(ValueError):
        dataset(ctx, [request], TargetRequest(Given(y)), on_leak="raise", **how)


def test_event_sources(ctx):
    assert SessionCloseEvents("XNYS", timedelta(seconds=10)).events(ctx, "2021-01-04", "2021-01-04").first()[0] == day("2021-01-04 21:00:10")
    assert FixedIntervalEvents("XNYS", timedelta(minutes=30)).events(ctx, "2021-01-04", "2021-01-05").count() == 13
    with pytest.raises(KeyError):
        SessionCloseEvents("NOPE").events(ctx, "2021-01-04", "2021-01-04")


def test_materialize_once(ctx, tmp_path):
    x = ctx.spark.createDataFrame([(day("2020-01-01"), "A", 1.0)], "ts_utc timestamp_ntz, entity_id string, `a.b:c` double")
    template, graph = Given(FeatureFrame(x, [{"feature_id": "a.b:c", "tags": {"k": 1}}])), LineageGraph()
    own = DataContext(ctx.spark, store=ParquetStore(ctx.spark, f"file://{tmp_path}/store"))
    real = FeatureRealization("given", "1.0", {}, SliceSpec(day("2020-01-01"), day("2020-01-02")))
    for _ in range(2):
        frame = materialize(own, template, real, MaterializationPolicy("always"), graph)
    assert template.calls == 1 and rows(frame.x) == rows(x) and frame.catalog[0]["tags"] == {"k": 1}
    assert frame.meta["realization_id"] == real.id() and graph.edges == [(real.id(), f"state:{real.id()}", "derives")]
    assert graph.nodes[real.id()]["kind"] == "feature" and graph.nodes[f"state:{real.id()}"]["kind"] == "artifact" and frame.meta["slice"]["end"].startswith("2020-01-02")
    assert pickle.loads(own.store.get_state(f"state:{real.id()}")) == {"n": 1} and own.store.index().where("kind = 'frame'").first().n_rows == 1
    assert own.store.get_frame("other") is None
    with pytest.raises(KeyError):
        own.store.get_state("none")
    cache = RawCache(ctx.spark, f"file://{tmp_path}/raw")
    assert cache.get("k") is None
    cache.set("k", x)
    assert rows(cache.get("k")) == rows(x)


# ---- splits and diagnostics ----------------------------------------------------------------------------------------
def test_splits(spark):
    days = [day("2020-01-01") + timedelta(days=k) for k in range(10)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    assert [r.test_start for r in rolling_splits(df, 4, 2, 2).orderBy("test_start").collect()] == [days[k] for k in (4, 6, 8)]
    assert [(r.train_start, r.test_start) for r in expanding_splits(df, 4, 2, 3).orderBy("test_start").collect()] == [(days[0], days[k]) for k in (4, 7)]
    folds = purged_kfold(df, 3).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {(0, "test"): 3, (0, "train"): 7, (1, "test"): 3, (1, "train"): 7, (2, "test"): 4, (2, "train"): 6}


def test_business_day_moves(spark):
    days = [day("2020-01-01") + timedelta(days=k) for k in range(14)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz").select(F.col("d").cast("date").alias("d"))
    for n in (-7, -5, -1, 1, 3, 5, 11):
        for r in df.select("d", _moved(F.col("d"), n).alias("m")).collect():
            assert r.m == (pd.Timestamp(r.d) + pd.offsets.BDay(n)).date(), (r.d, n)


def test_reports(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), None), (3.0, "d")], "x double, s string")
    got = {r.field: r for r in diag.column_report(df).collect()}
    assert (got["x"].n, got["x"].missing, got["x"].mean) == (4, 2, 2.0) and got["s"].mean is None and got["s"].missing_pct == 0.25
    cat = spark.createDataFrame([("f1", "t", "c", '{"k":"a"}'), ("f2", "t", "c", '{"k":"b"}'), ("f3", None, "c", "broken")], "feature_id string, source_table string, source_col string, tags_json string")
    imp = diag.attach_importance(cat, spark.createDataFrame([("f1", 0.7), ("f2", 0.3)], "feature_id string, importance double"))
    assert [r.importance for r in diag.importance_by_data(imp).collect()] == [1.0, 0.0]
    assert [(r.k, r.importance) for r in diag.importance_by_tag(imp, "k").collect()] == [("a", 0.7), ("b", 0.3)]
    times = spark.createDataFrame([(1, day("2020-01-01"), day("2020-01-02")), (2, day("2020-01-03"), day("2020-01-02"))], "k long, ts_utc timestamp_ntz, asof_utc timestamp_ntz")
    with pytest.raises(AssertionError):
        diag.assert_no_future_data(times)
    diag.assert_no_future_data(times.where("k = 1"))
    diag.assert_grid_is_monotone(times, "k")
    with pytest.raises(AssertionError):
        diag.assert_grid_is_monotone(times.withColumn("k", -F.col("k")), "k")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        FeatureFrame(df.limit(0).select(F.lit(None).cast("timestamp_ntz").alias("ts_utc"), F.lit("a").alias("entity_id")), []).validate()
