"""The Python data source, reads of one series, fingerprints and rebuilt parts, and what datasets say of themselves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairospark.operators import pit
from kairospark.plans.ids import feature_id
from kairospark.plans.snapshots import prints, refreshed, touched, upstream_snapshot
from kairospark.plans.specs import FeatureRealization, SliceSpec
from kairospark.plans.templates import CalendarFlags
from kairospark.functions.calendars import TradingCalendar
from kairospark.sources.catalog import Query
from kairospark.sources.context import DataContext
from kairospark.sources.series import NAME, SeriesData, StoredSeries, _files, put_series
from kairospark.streaming.pit_ingest import stream_into

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    data = [(f"s{k % 40:02}", T0 + timedelta(days=k // 40), float(k) if k % 7 else None, T0 + timedelta(days=k // 40 + 1)) for k in range(2000)]
    path = "file://" + str(tmp_path_factory.mktemp("series") / "store")
    put_series(spark.createDataFrame(data, "series_id string, date timestamp_ntz, value double, asof_utc timestamp_ntz"), path, files=5)
    return path, data


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_reach_the_reader_and_change_nothing(spark, series, pushed):
    path, data = series
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        source = StoredSeries(spark, "s", "t", path)
        q = Query("t", start=T0 + timedelta(days=5), end=T0 + timedelta(days=30), entities=["s03", "s17", "none"], asof=T0 + timedelta(days=20))
        df = source.fetch(q)
        assert rows(df) == sorted(((*r[:2], r[2], r[3]) for r in data if r[0] in ("s03", "s17") and 5 <= (r[1] - T0).days <= 20), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan kairospark_series" in plan and ("s03" in plan) == (pushed == "false")  # what the reader takes over, Spark doesn't filter again
        assert rows(source.fetch(Query("t"))) == sorted(data, key=str)
        assert source.fetch(Query("t", entities=["none"])).count() == 0
        panel = DataContext(spark, {"s": source}).fetch_panel("s", q)
        assert panel.columns[:2] == ["ts_utc", "entity_id"] and panel.count() == df.count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_streams_by_offsets(spark, series, tmp_path):
    """What comes later is read once, and the table of vintages ends with all rows."""
    path, data = series
    spark.dataSource.register(SeriesData)
    store, t = "file://" + str(tmp_path / "s"), pit.PitTable(spark, str(tmp_path / "pit"))
    whole = spark.createDataFrame(data, "series_id string, date timestamp_ntz, value double, asof_utc timestamp_ntz")
    for part in range(2):
        put_series(whole.where(F.pmod(F.xxhash64("series_id"), F.lit(2)) == part), f"{store}/p{part}", files=2)
        stream = spark.readStream.format(NAME).option("path", store).load().select(F.col("series_id").alias("series_key"), F.col("date").alias("obs_date"), "asof_utc", "value")
        stream_into(stream, t, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(_files(store)[1]) == 4
    assert rows(t.read().select("series_key", "obs_date", "value", "asof_utc")) == sorted(data, key=str)


def test_one_series_is_in_few_files(spark, tmp_path):
    rng = random.Random(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t, all_ = pit.PitTable(spark, str(tmp_path / "t")), {}
        for part in range(3):
            batch = {(f"k{rng.randrange(200):03}", T0 + timedelta(days=rng.randrange(400)), T0): float(k) for k in range(1500)}
            t.upsert(spark.createDataFrame([(*k, v) for k, v in batch.items()], "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double"))
            all_ |= batch
        assert t.bounds().count() == 12 and t.bounds().agg(F.sum("n_rows")).first()[0] >= len(all_)
        for key in ("k000", "k077", "k199", "nothing"):
            assert len(t.files_with(key)) <= 3
            got = t.read(key).select("series_key", "obs_date", "asof_utc", "value")
            assert rows(got) == sorted(((*k, v) for k, v in all_.items() if k[0] == key), key=str)
        assert rows(t.read().select(*pit.KEY, "value")) == sorted(((*k, v) for k, v in all_.items()), key=str)
        t.compact()
        assert len(t.files_with("k077")) == 1 and t.read("k077").count() == sum(k[0] == "k077" for k in all_)
        assert pit.PitTable(spark, str(tmp_path / "none")).read("k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fingerprints(spark):
    data = [(k % 5, k, None if k % 3 == 0 else str(k), float(k), [k]) for k in range(300)]
    df = spark.createDataFrame(data, "p int, k int, s string, x double, a array<int>")
    one = upstream_snapshot(df)
    assert one == upstream_snapshot(df.repartition(9, "s").select("a", "x", "p", "s", "k")) and len(one) == 16
    others = [df.where("k != 7"), df.unionByName(df.where("k = 7")), df.withColumn("x", F.when(F.col("k") == 7, 0.5).otherwise(F.col("x"))), df.withColumnRenamed("x", "y"), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumn("k", F.col("k").cast("long")), df.limit(0)]
    assert len({one, *map(upstream_snapshot, others)}) == 1 + len(others)
    changed = df.where("k != 7").unionByName(df.where("p = 3").withColumn("p", F.lit(9))).where("p != 4")
    assert rows(touched(prints(df, ["p"]), prints(changed, ["p"]), ["p"])) == [(2, False), (4, True), (9, False)]
    assert rows(touched(prints(df), prints(df), [])) == []
    ids = {FeatureRealization("t", "1", {}, SliceSpec("a", "b"), upstream_snapshot(d)).id() for d in (df, df.repartition(3), others[0])}
    assert len(ids) == 2


def test_only_touched_parts_are_built(spark, tmp_path):
    built = []

    def build(own):
        built.append(sorted((r[0] for r in own.select("p").distinct().collect()), key=str))
        return own.groupBy("p").agg(F.sum("x").alias("total"))

    df = spark.createDataFrame([(k % 4 or None, float(k)) for k in range(100)], "p int, x double")
    root = str(tmp_path / "r")
    read = lambda: {r.p: r.total for r in spark.read.parquet(f"{root}/data").collect()}
    want = lambda d: {r.p: r.total for r in d.groupBy("p").agg(F.sum("x").alias("total")).collect()}
    assert refreshed(spark, root, df, "p", build).count() == 4 and read() == want(df)
    assert refreshed(spark, root, df.repartition(5), "p", build).count() == 0 and len(built) == 1
    later = df.withColumn("x", F.when(F.col("p") == 2, F.col("x") + 1).otherwise(F.col("x"))).where("p is null or p != 3")
    assert rows(refreshed(spark, root, later, "p", build)) == [(2, False), (3, True)]
    assert built[1:] == [[2]] and read() == want(later)


def test_one_flag_as_text(spark):
    ctx = DataContext(spark, calendars={"XNYS": TradingCalendar()})
    get = lambda **p: CalendarFlags().transform(ctx, p, SliceSpec(T0, T0 + timedelta(days=9), ["A"]))
    one = get(flags="dow")
    assert one.features == get(flags=("dow",)).features == [feature_id("calendar.XNYS", "*", "calendar", "dow", {})]
    assert [(r.dow, r.one_hot) for r in one.catalog_frame().collect()] == [(None, False)]
    assert [(r.dow, r.one_hot) for r in get(flags="dow", one_hot_dow=True).catalog_frame().collect()] == [(k, True) for k in range(7)]
    assert one.meta == {"template": "calendar_flags", "version": "1.0"}
    with pytest.raises(KeyError):
        get(flags="dowry")
