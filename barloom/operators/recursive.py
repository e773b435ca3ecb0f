"""Recursive indicators, and those on long windows, in one grouped pass.

Exponential and Wilder means and the parabolic SAR depend on the row before, which no window expresses;
Hurst exponent and entropy need whole windows, for which numpy's sliding views spare an array a row. One ``mapInArrow`` over sorted
bars computes all of them, so that bars cross the Arrow boundary once, and many short pairs as one stack. A task holds an Arrow batch
and what it has of the batch's last pair, whose history is bounded by time (a decade of
hourly bars is 88,000 rows), not by the number of pairs, which is what grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.params import Params

from .kernels import Runs, entropy, hurst, over, parabolic_sar, rsi, smooth, step, true_range, wilder
from .multi_timeframe import MTF, frame_columns

MOMENTUM = ("rsi_1h", "rsi_slope_1h", "macd_slope_1h", "macd_hist_slope_1h", "tsi", "ppo")
VOLATILITY = ("atr_1h", "normalized_atr_14", "keltner_channel_width", "chaikin_volatility", "parabolic_sar_1h")
VOLUME = ("klinger_oscillator", "volume_oscillator", "volume_zone_oscillator")
STATISTICAL = ("hurst_exponent", "shannon_entropy")
COLUMNS = (*MOMENTUM, *VOLATILITY, *VOLUME, *STATISTICAL)


def recursive_columns(bars: pd.DataFrame, p: Params, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """All recursive columns of one pair's bars, ascending in time, or of a stack of pairs whose first rows are ``first``."""
    m, v, q = p.momentum, p.volatility, p.volume
    o, h, lo, c, vol = (bars[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume"))
    runs = Runs(len(c), first)
    ewm = lambda x, span: smooth(x, span, runs)
    begin = runs.at == 0
    dc = c - runs.before(c, c)
    up_tick = h + lo + c > runs.before(h + lo + c, np.inf)
    rs = rsi(c, m.rsi, runs)
    macd = ewm(c, m.macd_fast) - ewm(c, m.macd_slow)
    hist = macd - ewm(macd, m.macd_signal)
    drive, size = ewm(ewm(dc, m.tsi_fast), m.tsi_slow), ewm(ewm(abs(dc), m.tsi_fast), m.tsi_slow)
    slow = ewm(c, m.ppo_slow)
    tr = true_range(h, lo, c, runs)
    atr = np.where(runs.rows > v.atr, wilder(tr, v.atr, v.atr - 1, 0.0, runs), 0.0)
    hl = ewm(h - lo, v.chaikin)
    chaikin = np.where(begin, 0.0, hl / np.maximum(runs.before(hl, hl), 1e-8) - 1)
    cm = over((c - lo) - (h - c), h - lo, h > lo)
    force = np.where(begin, 0.0, vol * np.where(up_tick, 1.0, -1.0) * abs(cm) * 2)
    rose = np.where(begin, 0.0, vol * (dc > 0))
    fell = np.where(begin, 0.0, vol * (dc <= 0))
    base = ewm(vol, q.vzo)
    vzo = over(100 * (ewm(rose, q.vzo) - ewm(fell, q.vzo)), base, base > 0)
    return {
        "rsi_1h": rs, "rsi_slope_1h": step(rs, 3, runs), "macd_slope_1h": step(macd, 1, runs), "macd_hist_slope_1h": step(hist, 1, runs),
        "tsi": over(100 * drive, size, size != 0), "ppo": over(100 * (ewm(c, m.ppo_fast) - slow), slow, slow > 0),
        "atr_1h": atr, "normalized_atr_14": over(atr, c, c > 0), "keltner_channel_width": 2 * v.keltner_width * atr,
        "chaikin_volatility": chaikin, "parabolic_sar_1h": parabolic_sar(h, lo, c, v.sar_start, v.sar_step, v.sar_max, runs),
        "klinger_oscillator": ewm(force, q.klinger_fast) - ewm(force, q.klinger_slow),
        "volume_oscillator": ewm(vol, q.oscillator_fast) - ewm(vol, q.oscillator_slow), "volume_zone_oscillator": vzo,
        "hurst_exponent": hurst(c, p.statistical.hurst, p.statistical.hurst_max_lag, runs), "shannon_entropy": entropy(c, p.statistical.entropy, p.statistical.entropy_bins, runs),
    }


def passed(df: DataFrame, keys: tuple, columns: tuple, make: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with double ``columns``, which ``make`` gives of OHLCV, epoch microseconds and first rows of a stack of whole groups, each ascending in time.

    Groups are numbered and sorted by Spark and come many to an Arrow batch; a batch's last one waits for the next, which may go on with it.
    Every other column passes through in Arrow: pandas would hand NaN back as null.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    # This window deals the rows by key where they are not yet, and marks where groups begin.
    rows = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp_utc"))).sortWithinPartitions(*keys, "timestamp_utc")

    def made(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        stack = pa.concat_tables(parts).combine_chunks()
        first = np.flatnonzero(stack["__row"].to_numpy() == 1)
        got = make(stack.select(["open", "high", "low", "close", "volume"]).to_pandas(), stack["timestamp_utc"].cast(pa.int64()).to_numpy(), first)
        stack = stack.drop_columns(["__row"])
        for c in columns:
            stack = stack.append_column(c, pa.array(got[c], pa.float64(), from_pandas=True))
        return iter(stack.to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            begins = np.flatnonzero(rows["__row"].to_numpy() == 1)
            if len(begins):
                last = int(begins[-1])
                if waiting or last:
                    yield from made([*waiting, rows.slice(0, last)])
                waiting, rows = [], rows.slice(last)
            waiting.append(rows)
        if waiting:
            yield from made(waiting)

    return rows.mapInArrow(run, schema)


def grouped_pass(df: DataFrame, p: Params | None, columns: tuple, closed_bars_only: bool = False, complete: bool = False) -> DataFrame:
    """``df`` with ``columns``, recursive ones and those of higher frames; every other column passes through.

    After window features of the same pair the rows are already dealt and sorted: no further shuffle.
    """
    p = p or Params()

    def make(bars: pd.DataFrame, micros: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        made = recursive_columns(bars, p, first) if any(c in COLUMNS for c in columns) else {}
        return made | (frame_columns(bars, micros, closed_bars_only, complete, first) if any(c in MTF for c in columns) else {})

    return passed(df.select(*(c for c in df.columns if c not in columns)), ("pair",), columns, make)


def recursive(df: DataFrame, p: Params | None = None, columns: tuple = COLUMNS) -> DataFrame:
    """``df`` with the recursive ``columns``."""
    return grouped_pass(df, p, columns)
