"""Histories cut by time: scans and halos against the passes that hold a pair whole."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import numbered
from barloom.operators import features, halo, slots
from barloom.operators.recursive import recursive
from barloom.params import Momentum, Params
from barloom.plans.pipeline import compute_features

SCHEMA = "pair string, timestamp_utc timestamp, open double, high double, low double, close double, volume double"


def gappy(spark, sizes, seed=3, low=90.0):
    """Bars of several pairs with gaps of hours to weeks, flat and repeated prices, and prices of 0 or less if ``low`` allows."""
    draw, rows = np.random.default_rng(seed), []
    for k, n in enumerate(sizes):
        at = datetime(2024, 1, 1) + timedelta(minutes=7 * k)
        price = low + 10 + np.round(np.cumsum(draw.normal(0, 1, n)), 1)
        for i in range(n):
            at += timedelta(hours=int(draw.choice([1, 1, 1, 2, 30, 400], p=[0.5, 0.2, 0.15, 0.1, 0.045, 0.005])))
            o, c = price[max(i - 1, 0)], price[i]
            rows.append((f"p{k}", at, float(o), float(max(o, c) + draw.integers(0, 3)), float(min(o, c) - draw.integers(0, 3)), float(c), float(draw.integers(0, 9))))
    return spark.createDataFrame(rows, SCHEMA)


def table(df, columns):
    out = df.select("pair", "timestamp_utc", *columns).toPandas()
    return out.sort_values(["pair", "timestamp_utc"]).reset_index(drop=True)


def equal(a, b, columns):
    assert len(a) == len(b) > 0
    for c in columns:
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        assert (np.isnan(x) == np.isnan(y)).all() and np.nanmax(np.abs(x - y) / np.maximum(1, np.abs(y)), initial=0) < 1e-9, c


@pytest.mark.parametrize("width", ["5 hours", "4 days", "1000 days"])
@pytest.mark.parametrize("low", [90.0, -8.0])
def test_scan_equals_the_pass_by_pair(spark, width, low):
    """Slots of single rows, shorter than warm-up, and of all rows; prices that start the running sum anew."""
    bars = gappy(spark, (1, 2, 3, 13, 14, 15, 16, 40, 160), low=low)
    got = table(slots.recursive_by_slot(bars.repartition(5), width=width), slots.COLUMNS)
    equal(got, table(features.volume(numbered(recursive(bars))), slots.COLUMNS), slots.COLUMNS)
    if low < 0:
        assert bars.where("close <= 0").count() > 0


def test_scan_with_other_periods_and_columns(spark):
    bars = gappy(spark, (90, 30)).withColumns({"rsi_1h": F.lit(7.0), "slot": F.lit("x"), "tail": F.lit(1), "states": F.lit("q")})
    p = Params(momentum=Momentum(rsi=5, macd_fast=3, macd_slow=7, macd_signal=4, tsi_fast=2, tsi_slow=9))
    got = slots.recursive_by_slot(bars, p, "2 days", ("rsi_1h", "tsi"))
    assert got.columns == [*(c for c in bars.columns if c != "rsi_1h"), "rsi_1h", "tsi"]
    equal(table(got, ("rsi_1h", "tsi")), table(recursive(bars, p), ("rsi_1h", "tsi")), ("rsi_1h", "tsi"))
    assert got.where("states = 'q'").count() == 120


def test_null_pairs_and_no_bars(spark):
    bars = gappy(spark, (30, 20)).withColumn("pair", F.when(F.col("pair") == "p0", F.col("pair")))
    got = slots.recursive_by_slot(bars, width="3 days")
    assert got.where("pair is null").count() == 20 and got.count() == 50
    assert halo.features_by_slot(bars, groups=("price_action", "labels"), width="3 days", block_rows=110).where("pair is null").count() == 20
    assert slots.recursive_by_slot(bars.limit(0)).count() == 0 and halo.features_by_slot(bars.limit(0)).count() == 0
    assert slots.numbered_by_slot(bars, "3 days").where("pair is null and __n = 20 and __i between 0 and 19").count() == 20


def test_plan_deals_by_pair_and_slot(spark):
    """Rows travel by pair and slot; by pair alone travels only the table of slots."""
    plan = slots.recursive_by_slot(gappy(spark, (50,)))._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("__slot" in e for e in exchanges)
    rows_by_pair = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert len(rows_by_pair) == 1 and "compose" in rows_by_pair[0]  # one group a pair, over slots
    halos = halo.features_by_slot(gappy(spark, (50,)), groups=("price_action", "labels"))
    windows = re.findall(r"windowspecdefinition\(([^,]*),", halos._jdf.queryExecution().analyzed().toString())
    assert windows and not any(w.startswith("__pair") for w in windows)


def test_halos_equal_the_full_run_where_rows_and_hours_differ(spark):
    bars = gappy(spark, (1, 7, 20, 119, 120, 700), seed=8)
    groups = (*halo.GROUPS, "recursive")
    full = compute_features(bars, Params(), list(groups)).drop("parabolic_sar_1h")
    columns = [c for c in full.columns if c not in ("pair", "timestamp_utc") and full.schema[c].dataType.simpleString() != "boolean"]
    want = table(full, columns)
    for rows in (120, 1000):
        made = halo.features_by_slot(bars, Params(), groups, "6 days", rows)
        assert sorted(made.columns) == sorted(full.columns)
        equal(table(made, columns), want, columns)
    again = halo.parabolic_by_pair(made.select(*bars.columns))
    equal(table(again, ["parabolic_sar_1h"]), table(compute_features(bars, Params(), ["recursive"]), ["parabolic_sar_1h"]), ["parabolic_sar_1h"])
    with pytest.raises(ValueError, match="shorter"):
        halo.features_by_slot(bars, block_rows=50)


def test_halo_copies_are_bounded(spark):
    rows = slots.numbered_by_slot(gappy(spark, (900, 5)), "10 days")
    copies = halo.with_halos(rows, 20, 30, 100)
    sizes = copies.groupBy("pair", "__block").count().collect()
    assert max(r["count"] for r in sizes) == 150 and halo.own_rows(copies, 100).count() == 905
