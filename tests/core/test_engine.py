"""Operators against plain loops, registered queries against DuckDB, metamorphic and streaming tests."""

import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions import frames
from barloom.operators import features, gaps, halo, joins, kernels, recursive, upsert
from barloom.operators.cross_pair import percent_rank_of
from barloom.operators.multi_timeframe import complete_grid, multi_timeframe, resample
from barloom.oracles.sql import SQL
from barloom.params import Params
from barloom.plans import pipeline, reports
from barloom.quality import validators
from barloom.queries import QUERIES
from barloom.sources import raw
from barloom.streaming.candles import affected_tail, candle_stream, current_bars, event_stream, ewm_stream, write_bars

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def bars(spark, closes, pair="a", **cols):
    rows = []
    for i, c in enumerate(closes):
        row = {"open": c, "high": c + 1.0, "low": c - 1.0, "close": c, "volume": 1.0 + i % 3} | {k: v[i] for k, v in cols.items()}
        rows.append((pair, T0 + timedelta(hours=i), *(float(row[k]) for k in ("open", "high", "low", "close", "volume"))))
    return spark.createDataFrame(rows, "pair string, timestamp_utc timestamp, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    return list(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = plain(got), plain(want)
    for c in a:
        off = a[c] != b[c]
        if off.any():  # the last digit may differ where sums run in another order
            assert np.allclose(a[c][off].astype(float), b[c][off].astype(float), rtol=1e-6, atol=2e-5), (name, c)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_recursive_columns_against_loops(spark):
    c = np.array(walk(120))
    df = pd.DataFrame({"open": c, "high": c + 1, "low": c - 1, "close": c, "volume": np.arange(120.0) % 5})
    got = recursive.recursive_columns(df, Params())
    d = np.diff(c)
    up, down = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    assert (got["rsi_1h"][:14] == 50).all() and got["rsi_1h"][14] == pytest.approx(100 - 100 / (1 + up / down))
    for x in d[14:]:
        up, down = (13 * up + max(x, 0)) / 14, (13 * down + max(-x, 0)) / 14
    assert got["rsi_1h"][-1] == pytest.approx(100 - 100 / (1 + up / down))
    tr = kernels.true_range(c + 1, c - 1, c)
    atr = tr[:14].mean()
    assert got["atr_1h"][12] == 0 and got["atr_1h"][13] == pytest.approx(atr)
    e12 = e26 = c[0]
    for x in c[1:]:
        e12, e26 = 2 / 13 * x + 11 / 13 * e12, 2 / 27 * x + 25 / 27 * e26
    assert got["ppo"][-1] == pytest.approx(100 * (e12 - e26) / e26)
    r = np.diff(np.log(c[5:105]))
    y = [np.log(np.sqrt(np.mean((r[k:] - r[:-k]) ** 2))) for k in range(1, 21)]
    slope = np.polyfit(np.log(np.arange(1, 21)), y, 1)[0]
    assert got["hurst_exponent"][105] == pytest.approx(min(1, max(0, slope / 2))) and got["hurst_exponent"][99] == 0
    assert (kernels.hurst(c[:99], 100, 20) == 0.5).all()
    for n in (0, 1, 2, 13, 14, 15, 20, 21):
        short = recursive.recursive_columns(df.iloc[:n], Params())
        assert all(len(v) == n and np.isfinite(v).all() for v in short.values())


def test_constant_prices_and_zero_volume(spark):
    df = bars(spark, [5.0] * 60, high=[5.0] * 60, low=[5.0] * 60, volume=[0.0] * 60)
    out = pipeline.compute_features(df, Params()).toPandas()
    nums = out.select_dtypes("number")
    assert np.isfinite(nums.to_numpy(float)).all()
    assert (out.relative_close_position == 0.5).all() and (out.pattern_doji == 1).all() and (out.rsi_1h[20:] == 100).all() and (out.stoch_k_14[20:] == 50).all()


def test_scaling_prices_leaves_ratios(spark):
    groups = ["momentum", "volatility", "recursive", "pattern"]
    a = pipeline.compute_features(bars(spark, walk(80)), groups=groups).toPandas()
    b = pipeline.compute_features(bars(spark, walk(80)).withColumns({c: F.col(c) * 8 for c in ("open", "high", "low", "close")}), groups=groups).toPandas()
    for c in ("rsi_1h", "stoch_k_14", "bollinger_percent_b", "williams_r_14", "tsi", "normalized_atr_14"):
        assert np.allclose(a[c], b[c]), c


def test_appended_rows_do_not_change_the_past(spark):
    groups = ["price_action", "momentum", "volume", "recursive", "statistical"]
    whole = pipeline.compute_features(bars(spark, walk(130)), groups=groups).orderBy("timestamp_utc").toPandas()
    part = pipeline.compute_features(bars(spark, walk(130)[:110]).repartition(3), groups=groups).orderBy("timestamp_utc").toPandas()
    for c in pipeline.feature_columns(pipeline.compute_features(bars(spark, walk(3)), groups=groups)):
        if c != "donchian_channel_width_1h":
            assert np.allclose(whole[c][:110], part[c]), c


def test_label_tails(spark):
    out = pipeline.compute_features(bars(spark, walk(60)), groups=["labels"]).orderBy("timestamp_utc").toPandas()
    assert (out.future_return_4h_pct[-4:] == 0).all() and (out.future_max_return_24h_pct[-25:] == 0).all() and (out.future_max_drawdown_12h_pct[-13:] == 0).all()
    gain = out.future_return_12h_pct.iloc[-13]
    assert out.future_risk_adj_return_12h.iloc[-13] == pytest.approx(gain / 1e-8)


def test_no_second_shuffle_for_window_and_recursive_groups(spark):
    df = pipeline.compute_features(bars(spark, walk(30)), groups=["price_action", "volatility", "volume", "labels", "recursive", "multi_timeframe"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_full_plan_has_one_shuffle_for_each_dealing(spark):
    plan = QUERIES["full_backfill"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # The bars' aggregation, the pair, the time, and the pair again.
    assert plan.count("Exchange hashpartitioning") == 4


def test_ranks_with_ties(spark):
    rows = [(p, T0, v) for p, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", 9.0))] + [("a", T0 + timedelta(hours=1), 4.0), ("a", T0 + timedelta(hours=2), 0.0), ("b", T0 + timedelta(hours=2), -1.0)]
    df = spark.createDataFrame(rows, "pair string, timestamp_utc timestamp, v double").withColumn("r", percent_rank_of("v"))
    got = {(r.pair, r.timestamp_utc.hour): r.r for r in df.collect()}
    assert [got[p, 0] for p in "abcde"] == [0, 38, 38, 75, 100] and got["a", 1] == 50 and got["a", 2] == 50


def test_gaps_fill_and_grid(spark):
    df = bars(spark, walk(10)).where(~F.hour("timestamp_utc").isin(3, 4, 7))
    assert [r.missing for r in gaps.gaps(df).orderBy("gap_start").collect()] == [2, 1]
    assert gaps.missing_hours(df).count() == 3
    near = bars(spark, walk(10)).where("hour(timestamp_utc) in (3, 7)").withColumn("timestamp_utc", F.expr("timestamp_utc + interval 100 seconds"))
    assert gaps.fill_gaps(df, near).count() == 9
    assert complete_grid(df, "1 hour").count() == 10
    assert resample(df, "4 hours").count() == 3 and multi_timeframe(df).where("rsi_4h <> 0").count() == 0


def test_asof_ties_and_unmatched(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("c", 1, 4.0)], "k string, u int, v double")
    assert {(r.k, r.t): r.v for r in joins.asof_backward(left, right, "k", "t", "u", ["v"]).collect()} == {("a", 5): 3.0}
    assert joins.asof_backward(left, right, "k", "t", "u", ["v"], keep_unmatched=True).count() == 4


def test_asof_over_slots_against_a_loop(spark):
    rng = np.random.default_rng(5)
    left = [(str(k), int(t)) for k, t in zip(rng.integers(0, 4, 300), rng.integers(0, 500, 300), strict=True)] + [(None, 7)]
    right = [(str(k), int(t), float(t * 10 + k)) for k, t in zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60), strict=True)] + [(None, 1, 1.0)]
    want = sorted((k, t, max(((u, v) for j, u, v in right if j == k and u <= t), default=(0, None))[1] if k is not None else None) for k, t in left[:-1])
    a, b = spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, u int, v double")
    for slot in (1, 7, 86_400):
        got = joins.asof_backward(a, b, "k", "t", "u", ["v"], keep_unmatched=True, slot=slot).collect()
        assert sorted(map(tuple, (r for r in got if r.k is not None))) == want, slot
        assert [r.v for r in got if r.k is None] == [None]
    assert joins.asof_backward(a.limit(0), b, "k", "t", "u", ["v"]).count() == 0 and joins.asof_backward(a, b.limit(0), "k", "t", "u", ["v"]).count() == 0


def test_bucketed_bars_need_no_shuffle(spark):
    plan = QUERIES["write_bucketed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_recheck_without_known_columns(spark):
    df = bars(spark, walk(5))
    issues = df.select("pair", F.col("timestamp_utc").alias("issue_time"), F.lit("close").alias("column"))
    assert validators.recheck(df, issues).count() == 0


def test_insert_ignore_and_join_update(spark):
    df = bars(spark, walk(5))
    assert upsert.insert_ignore(df.limit(0), df.unionByName(df)).count() == 5
    assert upsert.insert_ignore(df, df).count() == 0
    new = spark.createDataFrame([("a", T0, None), ("a", T0 + timedelta(hours=1), 77.0), ("z", T0, 1.0)], "pair string, timestamp_utc timestamp, close double")
    got = [r.close for r in upsert.join_update(df, new).orderBy("timestamp_utc").collect()]
    assert got[:2] == [0.0, 77.0] and len(got) == 5 and got[2] == pytest.approx(walk(5)[2])
    fitted = upsert.fit_schema(df.withColumns({"volume_rank_1h": F.lit(2.5), "new": F.lit(1), "id": F.lit(1)}), ["pair", "volume_rank_1h", "id"])
    assert fitted.dtypes == [("pair", "string"), ("volume_rank_1h", "smallint")] and fitted.first()[1] == 2


def test_partitioned_write_replaces_its_months(spark, tmp_path):
    df = bars(spark, walk(40))
    path = str(tmp_path / "bars")
    upsert.write_partitioned(df.unionByName(df.withColumn("timestamp_utc", F.expr("timestamp_utc + interval 40 days"))), path)
    upsert.write_partitioned(df.limit(3), path)
    assert spark.read.parquet(path).count() == 43


def test_params_from_ini():
    p = Params.from_ini("[MOMENTUM]\nrsi = 7\n[GENERAL]\nrolling = 99\n[FEATURES]\nlabels = false\nvolume = yes\n")
    assert p.momentum.rsi == 7 and p.rolling == 99 and p.disabled == {"labels"}


def test_toggles_and_registration(spark):
    df = bars(spark, walk(20))
    out = pipeline.compute_features(df, Params(disabled=frozenset({"calendar"})), ["price_action", "calendar"])
    assert "log_return" in out.columns and "hour_of_day" not in out.columns
    pipeline.register("doubled", lambda d, p: d.withColumn("doubled", 2 * F.col("close")))
    try:
        assert pipeline.compute_features(df, groups=["doubled"]).where("doubled = 2 * close").count() == 20
    finally:
        del pipeline.GROUPS["doubled"]


def test_raw_messages(spark):
    rows = [("x", '["1704067200000","1","2","0.5","1.5","10","","bad","1"]'), ("x", '["1","2"]'), ("x", None), ("x", "not json"), ("x", '["zz","1","2","0.5","1.5","10","1","1","0"]')]
    got = raw.parse_candles(spark.createDataFrame(rows, "symbol string, data string")).collect()
    assert len(got) == 1 and got[0].timestamp == T0 and got[0].volume_ccy is None and got[0].confirmed
    mark = raw.parse_price_candles(spark.createDataFrame([("BTC-USDT-SWAP", '["1704067200000","1","2","0.5","1.5","0"]')], "symbol string, data string"), index=True).first()
    assert mark.symbol == "BTC-USDT" and not mark.confirmed
    inst = spark.createDataFrame([("A-USDT-SWAP", None, None), ("B-USDT", "USDT", "live"), ("C-USDT", "USDT", "off")], "instId string, quoteCcy string, state string")
    assert sorted(r.symbol for r in raw.swap_pairs(inst).collect()) == ["A-USDT-SWAP", "B-USDT"]
    flags = spark.createDataFrame([("t",), ("YES",), ("0",), (None,)], "x string").select(frames.truthy(F.col("x"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]


def test_ties_of_event_times_do_not_depend_on_order(spark):
    from barloom.sources.candles import candles_from_events, of_pairs

    rows = [(i, "a", T0 + timedelta(minutes=i // 4), float(v)) for i, v in enumerate([5, 1, 9, 2, 7, 3, 8, 4])]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "event_id long, event_type string, ts timestamp_ntz, value double").repartition(3)
        got = candles_from_events(df)
        assert (got.first().open, got.first().close) == (5.0, 4.0)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    listed = spark.createDataFrame([("a",), ("a",), ("z",)], "pair string")
    assert of_pairs(got, listed).count() == 1
    many = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, None)], "pair string, timestamp_utc long, x double")
    assert sorted(map(tuple, upsert.insert_ignore(many.limit(0), many).collect())) == [("a", 1, 3.0), ("a", 2, None)]


def test_quantiles_and_moments_match_pandas(spark):
    values = [*np.random.default_rng(3).normal(0, 2, 501).round(1), float("nan"), None]
    df = spark.createDataFrame([("a", None if v is None else float(v)) for v in values] + [("b", 1.0)], "pair string, x double")
    r = {x.pair: x for x in validators.distributions(df, ["x"]).collect()}
    s = pd.Series([v for v in values if v is not None]).dropna()
    assert r["a"].n == 501 and r["a"].distinct == s.nunique() and r["b"].kurt is None
    assert np.allclose([r["a"].q1, r["a"].median, r["a"].q3, r["a"].iqr, r["a"].skew, r["a"].kurt], [s.quantile(0.25), s.median(), s.quantile(0.75), s.quantile(0.75) - s.quantile(0.25), s.skew(), s.kurt()])


def test_reports(spark):
    df = bars(spark, walk(50)).unionByName(bars(spark, walk(50, 2), "b"))
    s = reports.market_summary(df)
    assert s.count() == 2 and reports.movers(s, 1).count() == 3


def test_validators_find_planted_faults(spark):
    df = pipeline.compute_features(bars(spark, walk(60)), groups=["price_action", "labels", "recursive"])
    bad = df.withColumns({"high": F.when(F.hour("timestamp_utc") == 5, F.col("low") - 1).otherwise(F.col("high")), "rsi_1h": F.when(F.hour("timestamp_utc") == 6, 150.0).otherwise(F.col("rsi_1h"))})
    found = {(r.validator, r.issue_type, r.column): r.issues for r in validators.validate(bad).collect()}
    assert found["raw_ohlcv", "high_low_issues", "high"] == 3 and found["sanity", "range_violations", "rsi_1h"] == 3 and found["recursive", "calculation_mismatch", "rsi_1h"] == 3
    assert validators.validate(df).count() == 0
    check = validators.raw_checks(bad.columns)[0]
    assert validators.examples(bad, check, 2).count() == 2


def test_stream_drops_repeats_and_late_events(spark, tmp_path):
    def land(name, rows):
        pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"event_id": "int64", "user_id": "int64"})
        df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        bars = candle_stream(event_stream(spark, str(tmp_path / "in")), late="2 hours")
        write_bars(bars, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return {r.timestamp_utc.hour: (r.open, r.close, r.volume) for r in current_bars(spark, str(tmp_path / "out")).collect()}

    land("a", [(1, T0, 1, "x", 1.0, ""), (2, T0 + timedelta(minutes=30), 1, "x", 2.0, ""), (2, T0 + timedelta(minutes=30), 1, "x", 2.0, "")])
    assert run() == {0: (1.0, 2.0, 2.0)}
    land("b", [(3, T0 + timedelta(minutes=50), 1, "x", 7.0, ""), (4, T0 + timedelta(hours=9), 1, "x", 5.0, "")])
    assert run() == {0: (1.0, 7.0, 3.0), 9: (5.0, 5.0, 1.0)}
    land("c", [(5, T0 + timedelta(minutes=55), 1, "x", 99.0, ""), (6, T0 + timedelta(hours=10), 1, "x", 6.0, "")])
    assert run() == {0: (1.0, 7.0, 3.0), 9: (5.0, 5.0, 1.0), 10: (6.0, 6.0, 1.0)}


def test_stateful_mean_over_micro_batches(spark, tmp_path):
    c = walk(30)
    df = bars(spark, c).toPandas()
    for k in range(3):
        spark.createDataFrame(df.iloc[k * 10 : k * 10 + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "pair string, timestamp_utc timestamp, open double, high double, low double, close double, volume double"
    files = sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
    for k, f in enumerate(files):
        os.utime(f, (1000 + k * 10, 1000 + k * 10))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ewm_stream(s).writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.ewm for r in spark.table("means").orderBy("timestamp_utc").collect()]
    assert np.allclose(got, kernels.ewm(np.array(c), 12))


def test_affected_tail(spark):
    df = bars(spark, walk(50))
    changed = df.where(F.col("timestamp_utc") >= F.lit(T0 + timedelta(hours=45)))
    assert affected_tail(df, changed, 10).count() == 15


def test_rolling_equals_full_for_windows(spark):
    df = bars(spark, walk(150))
    p = Params(rolling=40, look_back=60)
    a = pipeline.rolling_update(df, p, ["price_action", "volatility"]).orderBy("timestamp_utc").toPandas()
    b = pipeline.compute_features(df, p, ["price_action", "volatility"]).orderBy("timestamp_utc").toPandas().iloc[-40:].reset_index(drop=True)
    for c in ("log_return", "true_range", "bollinger_width_1h", "historical_vol_30"):
        assert np.allclose(a[c], b[c]), c


def test_features_module_is_lazy():
    assert callable(features.prices)

@pytest.mark.parametrize("made", ["pair", "slot"])
def test_close_of_zero_is_a_return_of_minus_infinity(spark, made):
    """As in the SQL: moments of windows that hold it are NaN, others are as before; a recomputation finds no issue there."""
    closes = [100.0 + (k * 7) % 13 for k in range(70)]
    closes[30] = 0.0
    df = bars(spark, closes).withColumn("low", F.least("low", "close"))
    groups = ("price_action", "statistical")
    full = halo.features_by_slot(df, Params(), groups, "10 hours", 120) if made == "slot" else pipeline.compute_features(df, Params(), list(groups))
    got = full.orderBy("timestamp_utc").toPandas()
    x = got["log_return"].to_numpy()
    assert x[30] == -np.inf and x[31] == 0 and np.isfinite(np.delete(x, 30)).all()
    for c in ("std_dev_returns_20", "skewness_20", "kurtosis_20", "autocorr_1"):
        assert np.flatnonzero(np.isnan(got[c])).tolist() == list(range(30, 50)), c
    assert validators.recomputed(full, {"statistical": list(groups)}, Params()).count() == 0
    off = full.withColumn("log_return", F.lit(0.0))
    assert validators.recomputed(off, {"statistical": list(groups)}, Params()).where("column = 'log_return'").first()["issues"] > 60


def test_grouped_pass_keeps_nan_and_null_apart(spark):
    df = bars(spark, walk(20)).withColumns({"x": F.when(F.col("close") > 100, float("nan")), "k": F.when(F.col("close") > 100, 7)})
    got = recursive.recursive(df, None, ("rsi_1h",))
    assert got.select("x", "k").exceptAll(df.select("x", "k")).count() == 0 and df.where("isnan(x)").count() > 0
    assert halo.long_windows(df, Params()).select("x", "k").exceptAll(df.select("x", "k")).count() == 0


def test_tidy_rounds_as_the_sql_does(spark, con):
    """Halves in the seventh place, their neighbours, and values whose scaled doubles are beyond 2^53."""
    draw = np.random.default_rng(5)
    x = np.concatenate([(draw.integers(0, 10**7, 2000) * 10 + 5) / 1e7, draw.normal(size=500) * 10.0 ** draw.integers(-6, 12, 500), [8.0046875, 8.004687499999999, 0.49999999999999994e-6, 1e305, -2.5e-6]])
    x = np.concatenate([x, -x, np.nextafter(x, 0)])
    got = pipeline.tidy(spark.createDataFrame(pd.DataFrame({"x": x, "vwma_20": x, "volume_price_trend": x}))).toPandas()
    want = con.execute("select round(x, 6) as x, round(x, 8) as vwma_20, round(x, 3) as volume_price_trend from (select unnest($1) as x)", [x.tolist()]).df()
    for c in want:
        assert (got[c] == want[c]).all(), c
    odd = pipeline.tidy(spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,), (-1e-9,)], "x double")).collect()
    assert [str(r.x) for r in odd] == ["nan", "-inf", "None", "0.0"]


def test_messages_are_read_once(spark):
    """Filters on parsed fields do not parse again; fields that are numbers, empty, null, nested or absent are as with a path each."""
    texts = ['{"tradeId":"1","px":"2.5","sz":3,"side":"buy","ts":"4000"}', '{"tradeId":5,"px":1e2,"sz":"1","side":{"a":[1]},"ts":7}', '{"tradeId":"2","px":"","sz":"1","ts":"1"}', '{"tradeId":null,"px":"1","sz":"1","ts":"1"}', "[]", "x", '{"px":"1"', None, '{"ts":"9","premium":"0.1","instId":"a","fundingTime":"8","realizedRate":""}']
    df = spark.createDataFrame([("p", t) for t in texts], "pair string, data string")
    got = raw.parse_trades(df)
    assert [tuple(r) for r in got.select("trade_id", "price", "quantity", "side", F.unix_millis("timestamp_utc")).orderBy("trade_id").collect()] == [("1", 2.5, 3.0, "buy", 4000), ("5", 100.0, 1.0, '{"a":[1]}', 7)]
    assert [tuple(r) for r in raw.parse_premiums(df, symbol="pair").select("symbol", "premium").collect()] == [("p", 0.1)]
    assert raw.parse_funding(df).where("symbol = 'a' and realized_rate = 0 and funding_rate is null").count() == 1 and raw.parse_funding(df).count() == 9
    written = df.select("pair", F.to_json(F.struct(F.col("data").alias("px"))).alias("data"))
    for made in (raw.parse_trades(written), raw.parse_premiums(written, symbol="pair"), raw.parse_funding(written)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("json_tuple(") == plan.count(".evaluate(struct(") == 1 and "get_json_object" not in plan
