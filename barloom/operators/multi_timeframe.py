"""Higher timeframes: bars of four hours and a day, their indicators, and the way back to hourly rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Runs, ewm, rsi, smooth, step, true_range

#: Microseconds of each higher frame.
WIDTHS = {"4h": 4 * 3_600_000_000, "1d": 24 * 3_600_000_000}
OHLCV = ("open", "high", "low", "close", "volume")
#: Least bars of a pair in each frame, for its columns to be there. Rows do not count: 20 hours may lie in 20 days.
LEAST_BARS = {"4h": 10, "1d": 7}
INDICATORS = ("rsi", "rsi_slope", "macd_slope", "macd_hist_slope", "atr", "bollinger_width", "donchian_channel_width", "money_flow_index", "obv_slope", "volume_change_pct")
MTF = tuple(f"{c}_{name}" for name in WIDTHS for c in (*OHLCV, *INDICATORS))


def resample(bars: DataFrame, width: str) -> DataFrame:
    """Bars of ``width`` (pair, timestamp_utc, open, high, low, close, volume, rows), epoch-aligned; empty ones are absent."""
    t = F.col("timestamp_utc")
    return bars.groupBy("pair", F.window(t, width).start.cast(dict(bars.dtypes)["timestamp_utc"]).alias("bar")).agg(
        F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", t).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("rows"),
    ).withColumnRenamed("bar", "timestamp_utc")


def complete_grid(bars: DataFrame, width: str) -> DataFrame:
    """``bars`` with a row for each absent bar between a pair's first and last: null prices, volume 0."""
    ends = bars.groupBy("pair").agg(F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("b"))
    grid = ends.select("pair", F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("timestamp_utc"))
    return grid.join(bars, ["pair", "timestamp_utc"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def frame_indicators(bars: pd.DataFrame, daily: bool, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The ten indicators of one pair's higher bars, or of a stack of pairs whose first rows are ``first``; both frames differ in warm-up rules."""
    h, lo, c, v = (bars[k].to_numpy(float) for k in ("high", "low", "close", "volume"))
    runs = Runs(len(c), first)
    ewm = lambda x, span: smooth(x, span, runs)
    k = 1 if daily else 2
    macd = ewm(c, 12) - ewm(c, 26)
    rs = rsi(c, runs=runs)
    full = runs.at >= (0 if daily else 19)
    sd = np.where(full, runs.window_std(c, 20), 0.0)
    wide = np.where(full, np.maximum.reduce(runs.window(h, 20, -np.inf)) - np.minimum.reduce(runs.window(lo, 20, np.inf)), 0.0)
    tp = (h + lo + c) / 3
    before, v1 = runs.before(tp, tp), runs.before(v, 0.0)
    up, down = (runs.window_sum(np.where(side, tp * v, 0.0), 14) for side in (tp > before, tp < before))
    with np.errstate(divide="ignore", invalid="ignore"):
        mfi = np.where((down > 0) & (runs.at >= (0 if daily else 13)), 100 - 100 / (1 + up / down), 100.0 if daily else 100 - 100.0 / 101)
        grown = np.where(v1 != 0, v / v1 - 1, 0.0)
    signed = np.where((runs.at == 0) & daily, v, np.sign(c - runs.before(c, c)) * v)
    return {
        "rsi": rs, "rsi_slope": step(rs, k, runs), "macd_slope": step(macd, 1, runs), "macd_hist_slope": step(macd - ewm(macd, 9), 1, runs),
        "atr": ewm(true_range(h, lo, c, runs), 14), "bollinger_width": 4 * sd, "donchian_channel_width": wide,
        "money_flow_index": mfi, "obv_slope": step(runs.sums(signed), k, runs), "volume_change_pct": grown,
    }


def skipping_rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """``rsi`` over closes of which some are missing: changes from or to a missing one are skipped, and missing rows carry the value before."""
    d = np.diff(close, prepend=np.nan)
    at = np.flatnonzero(~np.isnan(d))
    # As a series without gaps: n + 1 closes make the first value.
    value = rsi(np.concatenate([[0.0], np.cumsum(d[at])]), n)[1:]
    out = np.full(len(close), np.nan)
    out[at] = value
    return pd.Series(out).ffill().fillna(50.0).to_numpy()


def grid_indicators(bars: pd.DataFrame, daily: bool) -> dict[str, np.ndarray]:
    """The ten indicators over a grid of bars, empty ones with missing prices and volume 0.

    Exponential means carry their value over empty bars and weigh it by the positions that have passed; windows count
    positions, and those that need all of them have 0 where one is missing; Wilder's means skip; a volume before an empty bar is lost to
    its change. Without empty bars this is ``frame_indicators``.
    """
    h, lo, c, v = (bars[k].to_numpy(float) for k in ("high", "low", "close", "volume"))
    k, least = (1, 1) if daily else (2, 20)
    before = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - lo, np.fmax(abs(h - before), abs(lo - before)))
    macd = ewm(c, 12) - ewm(c, 26)
    rs = skipping_rsi(c)
    rolled = lambda x: pd.Series(x).rolling(20, min_periods=least)
    tp = (h + lo + c) / 3
    dt = np.diff(tp, prepend=np.nan)
    up, down = (pd.Series(np.where(side, tp * v, 0.0)).rolling(14, min_periods=1 if daily else 14).sum().to_numpy() for side in (dt > 0, dt < 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        mfi = 100 - 100 / (1 + np.where(down > 0, up / down, np.inf if daily else 100.0))
        grown = np.diff(v, prepend=v[0]) / np.concatenate([v[:1], v[:-1]])
    signed = np.nan_to_num(np.sign(c - before)) * v
    signed[0] = v[0] if daily else 0.0
    grown[:1] = 0.0
    return {
        "rsi": rs, "rsi_slope": step(rs, k), "macd_slope": step(macd), "macd_hist_slope": step(macd - ewm(macd, 9)), "atr": ewm(tr, 14),
        "bollinger_width": 4 * rolled(c).std().fillna(0.0).to_numpy(), "donchian_channel_width": (rolled(h).max() - rolled(lo).min()).fillna(0.0).to_numpy(),
        "money_flow_index": mfi, "obv_slope": step(np.cumsum(signed), k), "volume_change_pct": np.nan_to_num(grown, nan=0.0, posinf=0.0, neginf=0.0),
    }


def frame_columns(bars: pd.DataFrame, micros: np.ndarray, closed_bars_only: bool = False, complete: bool = False, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The columns of ``MTF`` for one pair's hourly bars, ascending in time, or for a stack of pairs whose first rows are ``first``; 0 where there are too few bars.

    complete: indicators are those of the whole grid of bars, empty ones included, which also counts for the least number of bars.
    """
    runs, out = Runs(len(bars), first), {}
    for name, width in WIDTHS.items():
        key = micros // width
        begins = (runs.at == 0) | (np.diff(key, prepend=0) != 0)
        at = np.flatnonzero(begins)  # the first row of each bar
        pair = np.cumsum(runs.at == 0) - 1
        bar_runs = np.flatnonzero(np.diff(pair[at], prepend=-1))  # the first bar of each pair
        o, h, lo, c, v = (bars[k].to_numpy(float) for k in OHLCV)
        made = {k: np.zeros(0) for k in OHLCV}
        if len(at):
            end = np.append(at[1:], len(bars)) - 1
            made = {"open": o[at], "high": np.maximum.reduceat(h, at), "low": np.minimum.reduceat(lo, at), "close": c[end], "volume": np.add.reduceat(v, at)}
        have, whose = key[at], pair[at]
        if complete:
            have, whose, made, bar_runs = laid_out(have, whose, made, bar_runs, name == "1d")
        else:
            made |= frame_indicators(pd.DataFrame(made), name == "1d", bar_runs)
        bar_count = np.diff(bar_runs, append=len(have))
        enough = bar_count[pair] >= LEAST_BARS[name]
        # The place of each row's bar: its own pair's bars ascend in time.
        wanted = key - closed_bars_only
        place = np.cumsum(begins) - 1 - closed_bars_only if not complete else bar_runs[pair] + wanted - have[bar_runs][pair]
        place = np.maximum(place, 0)
        there = enough & (have[place] == wanted) & (whose[place] == pair) if len(have) else enough
        out |= {f"{k}_{name}": np.where(there, x[place], 0.0) if len(have) else np.zeros(0) for k, x in made.items()}
    return out


def laid_out(have: np.ndarray, whose: np.ndarray, made: dict[str, np.ndarray], bar_runs: np.ndarray, daily: bool) -> tuple:
    """Bars of a stack of pairs on each pair's whole grid, empty ones included, with their indicators; missing values are 0."""
    parts, starts, n = [], [], 0
    for a, b in zip(bar_runs, np.append(bar_runs[1:], len(have)), strict=True):
        grid = np.arange(have[a], have[b - 1] + 1)
        full = {k: np.full(len(grid), 0.0 if k == "volume" else np.nan) for k in OHLCV}
        for k in OHLCV:
            full[k][have[a:b] - have[a]] = made[k][a:b]
        full |= grid_indicators(pd.DataFrame(full), daily)
        parts.append(({k: np.nan_to_num(x) for k, x in full.items()}, grid, np.full(len(grid), whose[a])))
        starts.append(n)
        n += len(grid)
    if not parts:
        return have, whose, {k: np.zeros(0) for k in (*OHLCV, *INDICATORS)}, bar_runs
    return np.concatenate([g for _, g, _ in parts]), np.concatenate([w for *_, w in parts]), {k: np.concatenate([d[k] for d, *_ in parts]) for k in parts[0][0]}, np.array(starts)


def multi_timeframe(df: DataFrame, p: object = None, closed_bars_only: bool = False, complete: bool = False) -> DataFrame:
    """``df`` with ten indicators and OHLCV of each higher frame.

    A row gets the values of the bar that encloses it, which includes later hours; with
    ``closed_bars_only`` those of the bar before, which was known. Missing values are 0. Indicators are
    computed on bars that have rows, or, if ``complete``, on the whole grid of bars (``grid_indicators``). One grouped pass
    resamples, computes and hands back, so that no bar is joined.
    """
    from .recursive import grouped_pass

    return grouped_pass(df, p, MTF, closed_bars_only, complete)
