"""Higher frames over empty bars."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import multi_timeframe as m
from barloom.operators.kernels import ewm, rsi
from barloom.operators.recursive import COLUMNS, grouped_pass, recursive_columns
from barloom.params import Params


def bars(n, seed=4):
    draw = np.random.default_rng(seed)
    c = 100 + np.cumsum(draw.normal(0, 1, n))
    return pd.DataFrame({"open": c, "high": c + draw.uniform(0, 1, n), "low": c - draw.uniform(0, 1, n), "close": c, "volume": draw.integers(0, 5, n).astype(float)})


def test_a_grid_without_empty_bars_is_the_plain_frame():
    for n in (1, 13, 14, 15, 16, 60):
        for daily in (False, True):
            plain, grid = m.frame_indicators(bars(n), daily), m.grid_indicators(bars(n), daily)
            for k in m.INDICATORS:
                assert np.allclose(plain[k], grid[k], rtol=1e-12), (n, daily, k)


def test_means_carry_and_skip():
    assert np.allclose(ewm(np.array([1, np.nan, 3.0]), 3), [1, 1, 7 / 3])
    c = bars(40)["close"].to_numpy()
    holed = np.insert(c, [20, 20, 30], np.nan)
    got = m.skipping_rsi(holed)
    assert got[20] == got[21] == got[19] == rsi(c)[19]  # empty bars carry
    again = np.delete(c, [20, 30])  # the change over a gap is skipped, as if the bar after it had no change of its own
    assert np.isfinite(got).all() and len(again) == 38 and np.allclose(got[:20], rsi(c)[:20])


def test_complete_frames_count_empty_bars():
    n = 30
    b = bars(n).assign(timestamp_utc=pd.to_datetime(np.where(np.arange(n) < 15, np.arange(n), np.arange(n) + 24 * 6), unit="h"))
    micros = b["timestamp_utc"].to_numpy("datetime64[us]").astype(np.int64)
    plain, grid = m.frame_columns(b, micros), m.frame_columns(b, micros, complete=True)
    assert not plain["rsi_1d"].any() and grid["rsi_1d"].all()  # two days have bars, seven lie between first and last
    assert (grid["close_4h"] == plain["close_4h"]).all() or not plain["close_4h"].any()
    closed = m.frame_columns(b, micros, closed_bars_only=True, complete=True)
    assert closed["close_4h"][15] == 0 and closed["volume_1d"][15] == 0  # the bar before is empty


def test_a_stack_of_pairs_gives_what_each_pair_gives():
    sizes = (1, 2, 13, 14, 15, 1, 21, 30, 99, 100, 101, 130, 260)
    parts = [bars(n, seed=n) for n in sizes]
    micros = [np.sort(np.random.default_rng(n).choice(24 * 60, n, replace=False)) * 3_600_000_000 for n in sizes]
    first = np.cumsum((0, *sizes))[:-1]
    stack, at = pd.concat(parts, ignore_index=True), np.concatenate(micros)
    got = recursive_columns(stack, Params(), first)
    for k, want in {k: np.concatenate([recursive_columns(b, Params())[k] for b in parts]) for k in got}.items():
        assert (got[k] == want).all(), k
    for closed in (False, True):
        for complete in (False, True):
            got = m.frame_columns(stack, at, closed, complete, first)
            alone = [m.frame_columns(b, t, closed, complete) for b, t in zip(parts, micros, strict=True)]
            for k in m.MTF:
                assert (got[k] == np.concatenate([a[k] for a in alone])).all(), (closed, complete, k)
            assert got["rsi_4h"].any() and got["rsi_1d"].any()


def test_short_pairs_share_a_call_and_long_ones_go_over_batches(spark):
    """Many pairs cost no call each; a pair that does not end with its Arrow batch goes on in the next."""
    rows = [(f"p{k}", t, *x) for k in range(40) for t, x in enumerate(bars(3 + 7 * (k % 9), seed=k).itertuples(index=False, name=None))]
    df = spark.createDataFrame(rows, "pair string, hour int, open double, high double, low double, close double, volume double").withColumn("timestamp_utc", F.timestamp_seconds(F.col("hour") * 10800))
    made = grouped_pass(df, Params(), (*COLUMNS, *m.MTF))
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    want = sorted(made.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(grouped_pass(df, Params(), (*COLUMNS, *m.MTF)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == len(rows) and any(r.rsi_4h for r in got)
    assert grouped_pass(df.limit(0), Params(), ("rsi_1h",)).count() == 0


def test_sparse_pairs_have_frames_by_their_bars():
    """20 hours of 20 days make 20 bars of either frame, as in the SQL."""
    b, micros = bars(20), np.arange(20) * 25 * 3_600_000_000
    got = m.frame_columns(b, micros)
    for name, daily in (("4h", False), ("1d", True)):
        assert (got[f"close_{name}"] == b["close"]).all()
        assert all((got[f"{k}_{name}"] == x).all() for k, x in m.frame_indicators(b, daily).items())
    assert not any(x.any() for x in m.frame_columns(bars(6), micros[:6]).values())


def test_means_are_equal_to_the_recursion_to_the_last_bit():
    """A quotient by a mean next to 0 shows the last bit of both: spans that are 0 for long, between spans of some size."""
    draw = np.random.default_rng(8)
    b = bars(400).assign(low=lambda d: np.where(draw.uniform(size=400) < 0.9, d["high"], d["low"]))
    x = (b["high"] - b["low"]).tolist()
    y = [x[0]]
    for v in x[1:]:
        y.append(2 / 11 * v + 9 / 11 * y[-1])
    want = [0.0, *(n / max(o, 1e-8) - 1 for o, n in zip(y, y[1:], strict=False))]
    assert recursive_columns(b, Params())["chaikin_volatility"].tolist() == want and max(want) > 1e3
