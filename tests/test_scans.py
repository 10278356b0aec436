"""Scans by ranges of time, positions, as-of values, overlaps and availability against plain code, and how a hot key's rows are spread."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from kairospark.functions.times import log
from kairospark.operators import pit
from kairospark.operators.align import AlignSpec, align_panel
from kairospark.operators.diagnostics import grid_faults, leakage_audit
from kairospark.operators.returns import lagged, log_returns, next_squared_return
from kairospark.operators.scans import neighbours, numbered, scanned, shifted
from kairospark.operators.splits import expanding_splits, overlapping, purged_kfold, rolling_splits, target_purged_kfold
from kairospark.operators.universe import restricted
from kairospark.queries import rounded
from kairospark.sources.catalog import TableSchema

T0 = datetime(2024, 1, 1)
PANEL = "ts_utc timestamp_ntz, entity_id string, x double, tie int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """One entity with nine tenths of the rows, gaps of many days, missing values, and times before 1970."""
    rng = random.Random(3)
    times = sorted(rng.sample(range(-3000, 60 * 24 * 40), 900))
    data = [(T0 + timedelta(minutes=m), "hot", rng.choice([None, rng.random()]), 0) for m in times]
    data += [(T0 + timedelta(days=50 * k), f"e{k % 7}", float(k), 0) for k in range(60)] + [(T0 - timedelta(days=25_000), "old", 1.5, 0), (datetime(1969, 12, 31, 23, 59), "old", 2.5, 0)]
    return spark.createDataFrame(data, PANEL).repartition(4)


SEGMENTS = [timedelta(hours=1), timedelta(days=3), timedelta(days=400)]


@pytest.mark.parametrize("segment", SEGMENTS)
@pytest.mark.parametrize("backward", [False, True])
def test_scans_by_range_are_those_by_key(hot, segment, backward):
    how = dict(last={"l": F.col("x")}, greatest={"g": F.struct("x", "ts_utc")}, count="n", ties=("tie",), backward=backward)
    assert rows(scanned(hot, **how, segment=segment)) == rows(scanned(hot, **how))


@pytest.mark.parametrize("segment", SEGMENTS)
def test_lags_by_range_are_those_by_key(hot, segment):
    """Lags longer than a range has rows, too, and ahead."""
    what = {f"k{k}": (F.col("x"), k) for k in (1, 2, 7, -1, -5, 0)}
    assert rows(shifted(hot, what, segment=segment)) == rows(shifted(hot, what))
    panel = hot.withColumn("x", F.abs("x") + 1)
    assert rows(lagged(panel, "x", [1, 3, -2], segment=segment)) == rows(lagged(panel, "x", [1, 3, -2]))
    assert rows(log_returns(panel, "x", segment=segment)) == rows(log_returns(panel, "x"))
    assert rows(next_squared_return(panel, "x", segment=segment)) == rows(next_squared_return(panel, "x"))


@pytest.mark.parametrize("method,limit,match", [("ffill", None, "exact"), ("ffill", 3, "exact"), ("interp", None, "exact"), ("none", None, "asof"), ("step_hold", 1, "asof")])
def test_alignment_by_range_is_that_by_entity(spark, hot, method, limit, match):
    days = hot.groupBy(F.to_date("ts_utc").cast("timestamp_ntz").alias("ts_utc"), "entity_id").agg(F.max("x").alias("x"))
    grid = spark.range(400).select((F.lit("2023-12-20").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts_utc"))
    made = [rows(align_panel(days, grid, TableSchema("t", native_freq="D"), AlignSpec(method, limit, match, segment=s))) for s in (None, timedelta(days=9))]
    assert made[0] == made[1]


def test_a_hot_keys_rows_are_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (20_000, 80_000):
            df = spark.range(n).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts_utc"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("entity_id"), F.col("id").cast("double").alias("x"))
            most = lambda out, made="x": max(out.select(made).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) / n  # noqa: B023, E731
            assert most(scanned(df, {"l": F.col("x")}), "l") > 0.9
            assert most(scanned(df, {"l": F.col("x")}, segment=timedelta(hours=6)), "l") < 0.5
            assert most(shifted(df, {"l": (F.col("x"), 3)}, segment=timedelta(hours=6)), "l") < 0.5
            members = spark.createDataFrame([(datetime(2023, 1, 1), "hot", True)], "date timestamp_ntz, entity_id string, is_member boolean")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            for after in (members, members.unionByName(members.withColumn("date", F.lit("2030-01-01").cast("timestamp_ntz")))):
                assert most(restricted(df, after)) > 0.85
                assert most(restricted(df, after, timedelta(hours=6))) < 0.5
                assert restricted(df, after, timedelta(hours=6)).count() == restricted(df, after).count() == n - n // 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("segment", [timedelta(days=1), timedelta(days=10), timedelta(days=2000)])
def test_membership_by_range(spark, segment):
    rng = random.Random(1)
    dates = sorted(rng.sample(range(0, 300), 12))
    matrix = [(T0 + timedelta(days=d), f"e{k}", rng.choice([True, True, False, None])) for d in dates for k in range(6)]
    panel = spark.createDataFrame([(T0 + timedelta(days=rng.randrange(-20, 500), minutes=rng.randrange(1440)), f"e{rng.randrange(7)}", float(k), k) for k in range(400)], PANEL)
    universe = spark.createDataFrame(matrix, "date timestamp_ntz, entity_id string, is_member boolean")
    assert rows(restricted(panel, universe, segment)) == rows(restricted(panel, universe))
    assert restricted(panel, universe.limit(0), segment).count() == 0


def test_positions(spark):
    values = [3, 1, 2, None, 5, 8, 13]
    df = spark.createDataFrame([(v, str(v)) for v in values], "d int, s string").repartition(3)
    placed, n = numbered(df, "d", parts=4)
    assert n == 7 and rows(placed.select("i", "d", "s")) == sorted([(i, v, str(v)) for i, v in enumerate([None, 1, 2, 3, 5, 8, 13])], key=str)
    assert rows(neighbours(placed, "i", {"before": ("d", -1), "now": ("d", 0), "second": ("d", 2)}).where("now > 2")) == [(3, 2, 3, 8), (4, 3, 5, 13), (5, 5, 8, None), (6, 8, 13, None)]
    assert numbered(df.limit(0), "d")[1] == 0


def test_splits_have_no_task_with_all_dates(spark):
    dates = spark.range(500).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("d"))
    for made in (rolling_splits(dates, 20, 5, 3), purged_kfold(dates, 4, 1), grid_faults(dates.withColumn("ts_utc", F.col("d")), "d")):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    assert grid_faults(dates.withColumn("ts_utc", F.when(F.minute("d") != 30, F.col("d")).otherwise(F.lit("2020-01-01").cast("timestamp_ntz"))), "d").count() == 8
    assert rolling_splits(dates.limit(0), 2, 1).count() == expanding_splits(dates.limit(0), 2, 1).count() == purged_kfold(dates.limit(0), 2).count() == 0


# ---- as-of of each row ---------------------------------------------------------------------------------------------
def vintage_rows(rng, n=400):
    keys = {}
    for k in range(n):
        obs = T0 + timedelta(days=30 * rng.randrange(12))
        keys[rng.choice("abc"), obs, obs + timedelta(days=rng.randrange(-20, 90))] = rng.choice([None, float(k)])
    return [(*k, v) for k, v in keys.items()]


@pytest.mark.parametrize("segment", [None, timedelta(days=20)])
@pytest.mark.parametrize("future", [False, True])
@pytest.mark.parametrize("obs", [None, "obs_date"])
def test_asof_values(spark, segment, future, obs):
    rng = random.Random(7)
    told = vintage_rows(rng)
    asked = [(k, rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *(T0 + timedelta(days=rng.randrange(-30, 500)) for _ in range(9))]), rng.choice([t[1] for t in told])) for k in range(300)]
    asked += asked[:5] + [(1000, told[0][0], told[0][2], told[0][1])]  # repeated rows, and the very moment
    want = []
    for k, series, ts, o in asked:
        known = [t for t in told if ts and t[0] == series and t[2] <= ts and (future or t[1] <= ts) and (not obs or t[1] == o)]
        best = max(known, key=lambda t: (t[1], t[2]), default=(None,) * 4)
        want.append((k, series, ts, *((o,) if obs else ()), *(best[2:] if obs else best[1:])))
    df = spark.createDataFrame(asked, "k int, series string, ts timestamp_ntz, obs_date timestamp_ntz").repartition(3)
    table = pit.normalized(spark.createDataFrame(told, "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double"))
    got = pit.asof_values(df if obs else df.drop("obs_date"), table, key="series", time="ts", obs=obs, future=future, segment=segment)
    assert rows(got) == sorted(want, key=str)


def test_asof_values_agree_with_snapshots(spark):
    told = pit.normalized(spark.createDataFrame(vintage_rows(random.Random(9)), "series_key string, obs_date timestamp_ntz, asof_utc timestamp_ntz, value double"))
    when = T0 + timedelta(days=200)
    one = spark.createDataFrame([(s, when) for s in "abc"], "series_key string, ts_utc timestamp_ntz")
    last = pit.snapshot(told, when).groupBy("series_key").agg(F.max(F.struct("obs_date", "asof_utc", "value")).alias("v")).select("series_key", "v.*")
    assert rows(pit.asof_values(one, told, future=True).drop("ts_utc")) == rows(last)
    with pytest.raises(ValueError):
        pit.asof_values(one.withColumn("value", F.lit(1)), told)


def test_asof_values_take_one_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = spark.range(10).select(F.col("id").cast("string").alias("series_key"), F.lit(T0).cast("timestamp_ntz").alias("ts_utc"))
        table = pit.normalized(one.select("series_key", F.col("ts_utc").alias("obs_date"), F.col("ts_utc").alias("asof_utc"), F.lit(1.0).alias("value")))
        assert pit.asof_values(one, table)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# ---- availability --------------------------------------------------------------------------------------------------
def test_all_six_states(spark):
    d = lambda text: datetime.fromisoformat(text)
    panel = spark.createDataFrame([
        (d("2020-01-31"), "A", 1.0, d("2020-02-10")), (d("2020-02-29"), "A", None, d("2020-03-10")), (d("2020-03-31"), "A", 3.0, None),
        (d("2021-01-31"), "A", 4.0, d("2021-02-10")), (d("2021-02-28"), "A", 5.0, d("2021-03-20")),
        (d("2020-01-31"), "B", 7.0, d("2020-02-10")), (d("2020-02-29"), "B", 8.0, d("2020-03-10")),
    ], "ts_utc timestamp_ntz, entity_id string, value double, out timestamp_ntz")
    times = ["2019-12-31", "2020-01-31", "2020-02-15", "2020-02-29", "2020-03-31", "2020-05-31", "2020-08-31", "2021-01-31", "2021-02-28"]
    grid = spark.createDataFrame([(d(t),) for t in times], "ts_utc timestamp_ntz")
    schema = TableSchema("t", native_freq="M", release_time_column="out")
    get = lambda spec, asof=None: {(r.entity_id, str(r.ts_utc)[:10]): (r.value, r.value__observed, r.value__availability) for r in align_panel(panel, grid, schema, spec, asof=asof).collect()}
    once = get(AlignSpec("ffill"), "2021-03-01")
    assert [once["A", t] for t in times] == [
        (None, False, "missing_unknown"), (1.0, True, "available"), (1.0, False, "no_update_expected"), (1.0, False, "temporary_outage"), (3.0, True, "available"),
        (3.0, False, "no_update_expected"), (3.0, False, "temporary_outage"), (4.0, True, "available"), (4.0, False, "not_yet_released"),
    ]
    assert [once["B", t][2] for t in times[5:]] == ["discontinued"] * 4
    own = get(AlignSpec("ffill"))
    assert [own["A", t] for t in times] == [
        (None, False, "missing_unknown"), (None, False, "not_yet_released"), (1.0, False, "no_update_expected"), (1.0, False, "not_yet_released"), (3.0, True, "available"),
        (3.0, False, "no_update_expected"), (3.0, False, "temporary_outage"), (3.0, False, "not_yet_released"), (4.0, False, "not_yet_released"),
    ]
    assert own["B", "2020-08-31"][2] == "temporary_outage" and own["B", "2021-01-31"][2] == "discontinued"
    assert get(AlignSpec("ffill", segment=timedelta(days=40))) == own
    assert get(AlignSpec("ffill", segment=timedelta(days=40)), "2021-03-01") == once
    assert get(AlignSpec("ffill", 20))["A", "2020-03-31"][0] == 3.0 and get(AlignSpec("ffill", 20))["A", "2020-05-31"][0] is None
    assert {k: v[0] for k, v in get(AlignSpec("none"), "2021-03-01").items() if v[0] is not None} == {("A", "2020-01-31"): 1.0, ("A", "2020-03-31"): 3.0, ("A", "2021-01-31"): 4.0, ("B", "2020-01-31"): 7.0, ("B", "2020-02-29"): 8.0}
    leaky = align_panel(panel, grid, schema, AlignSpec("none", respect_asof=False))
    assert leakage_audit(leaky).first()[0] == 5 and leakage_audit(align_panel(panel, grid, schema, AlignSpec("ffill"))).first()[0] == 0
    assert align_panel(panel, grid, schema, AlignSpec(add_missingness_channels=False)).columns == ["ts_utc", "entity_id", "value"]
    with pytest.raises(ValueError):
        align_panel(panel, grid, schema, AlignSpec("interp"))
    assert get(AlignSpec("interp"), "2021-03-01")["A", "2020-02-15"][0] == pytest.approx(1 + 2 / 3)
    daily = align_panel(panel, grid, TableSchema("t", native_freq="D", release_time_column="out"), AlignSpec("none"), asof="2021-03-01")
    assert daily.where("value__availability = 'no_update_expected'").isEmpty()


# ---- purging -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("segment", [None, timedelta(hours=3), timedelta(days=30)])
def test_overlaps(spark, segment):
    rng = random.Random(11)
    at = lambda: T0 + timedelta(minutes=rng.randrange(20_000))
    own = [(k, rng.choice("ab"), t := rng.choice([None, at()]), rng.choice([None, t and t + timedelta(minutes=rng.randrange(-5, 900))])) for k in range(300)]
    spans = [(rng.choice("abc"), t := at(), t + timedelta(minutes=rng.randrange(-3, 400))) for _ in range(25)] + [("a", None, T0)]
    hit = lambda r: r[2] is not None and any(s[0] == r[1] and s[1] and s[1] <= s[2] and s[1] <= max(r[2], r[3] or r[2]) and s[2] >= r[2] for s in spans)
    got = overlapping(spark.createDataFrame(own, "k int, g string, ts_utc timestamp_ntz, target_end timestamp_ntz"), spark.createDataFrame(spans, "g string, low timestamp_ntz, high timestamp_ntz"), key="g", segment=segment)
    assert rows(got) == sorted(((*r, hit(r)) for r in own), key=str)


def test_folds_purged_by_targets(spark):
    rng = random.Random(12)
    own = [(k, t := T0 + timedelta(hours=rng.randrange(500)), rng.choice([None, t + timedelta(hours=rng.randrange(60))])) for k in range(200)]
    df = spark.createDataFrame([*own, (999, None, None)], "k int, ts_utc timestamp_ntz, target_end timestamp_ntz")
    end = lambda r: max(r[1], r[2] or r[1])
    times = sorted({r[1] for r in own})
    fold = {t: min(i // (len(times) // 3), 2) for i, t in enumerate(times)}
    want = []
    for f in range(3):
        test = [r for r in own if fold[r[1]] == f]
        low, high = min(r[1] for r in test), max(map(end, test)) + timedelta(hours=5)
        want += [(*r, f, "test") for r in test] + [(*r, f, "train") for r in own if fold[r[1]] != f and (end(r) < low or r[1] > high)]
    for segment in (None, timedelta(hours=7)):
        assert rows(target_purged_kfold(df, 3, embargo=timedelta(hours=5), segment=segment)) == sorted(want, key=str)
    assert target_purged_kfold(df.limit(0), 3).count() == 0


# ---- checks within the plan ----------------------------------------------------------------------------------------
def test_repeated_keys_fail_the_job_that_reads_them(spark):
    """Nothing runs before, and the window shares the join's shuffles."""
    from pyspark.errors import PySparkException

    days = [T0 + timedelta(days=k) for k in range(4)]
    panel = spark.createDataFrame([(d, "A", 1.0) for d in days], "ts_utc timestamp_ntz, entity_id string, v double")
    grid = panel.select("ts_utc")
    released_panel = panel.withColumn("out", F.col("ts_utc"))
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for own, schema in ((panel, TableSchema()), (released_panel, TableSchema(release_time_column="out"))):
        for match in ("exact", "asof"):
            good = align_panel(own, grid, schema, AlignSpec(match=match), check="plan")
            bad = align_panel(own.union(own.limit(1)), grid, schema, AlignSpec(match=match), check="plan")
            assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == started
            assert good.count() == 4
            with pytest.raises(PySparkException, match="repeated key"):
                bad.collect()
            started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert align_panel(panel.limit(0), grid, TableSchema(), check="plan").count() == 0


def test_logs_are_those_of_the_c_library(spark):
    """To the last bit, so that rounded returns equal SQL's: with the JVM's ln the return from 187.31 to 169.04 rounds otherwise, and so does the square of that from 1e-300."""
    n = 20_000
    got = [r[0] for r in spark.range(1, n + 1).select(log(F.col("id") / 100)).collect()]
    assert got == [math.log(k / 100) for k in range(1, n + 1)]
    odd = spark.createDataFrame([(0.0,), (-0.0,), (-1.5,), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in odd.select(log(F.col("x"))).collect()] == [float("-inf"), float("-inf"), None, None, float("inf")]
    panel = spark.createDataFrame([(1, "a", 187.31), (2, "a", 169.04)], "ts_utc long, entity_id string, x double").withColumn("ts_utc", F.timestamp_seconds("ts_utc").cast("timestamp_ntz"))
    sql = duckdb.execute("SELECT round(ln(169.04::DOUBLE) - ln(187.31::DOUBLE), 8)").fetchall()[0][0]
    assert [r[0] for r in log_returns(panel, "x").orderBy("ts_utc").select(F.round("logret", 8)).collect()] == [None, sql]


def test_rounded_as_sql_rounds(spark):
    """Squares of large returns, of which F.round takes some the other way; signs and infinities stay."""
    own = [(math.log(k / 100) + 690.7755278982137) ** 2 for k in range(1, 20_000)] + [0.0, -1e-9, -0.5e-7, 1.5e-7, float("inf"), float("-inf")]
    got = [str(r[0]) for r in spark.createDataFrame([(x,) for x in own], "x double").select(rounded("x", 7)).collect()]
    assert got == [str(duckdb_row[0]) for duckdb_row in duckdb.connect().execute("SELECT round(x, 7) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [own]).fetchall()]
