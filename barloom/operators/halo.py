"""Window features cut by rows: each block of a pair's rows gets copies of the rows around it, and windows run by block.

A feature looks back a fixed number of rows and labels look ahead, so a block of rows with so many rows before and
after it holds all that its own rows need. Rows are numbered first (``slots.numbered_by_slot``), a time slot at a
time; blocks are then cut by row number, not by time, so that gaps, where rows and hours differ, change nothing. A
row is copied to the few blocks that it is near to; the copies are dropped when the features are there. What is
not of bounded reach, the running sums of the volume group, comes from ``slots.recursive_by_slot``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import features, slots
from barloom.params import Params

from .kernels import Runs, entropy, hurst
from .recursive import passed, recursive

#: Groups that windows of bounded reach express.
GROUPS = ("price_action", "momentum", "volatility", "volume", "statistical", "pattern", "calendar", "labels")
#: Running sums, which have no bounded reach, and columns of long windows that numpy computes.
SUMS, LONG = ("obv_1h", "obv_slope_1h", "volume_price_trend"), ("hurst_exponent", "shannon_entropy")
#: Own rows of a block.
BLOCK_ROWS = 4096


def reach(p: Params) -> tuple[int, int]:
    """Rows that features look back and ahead, nested windows (a mean of stochastics, an acceleration of returns) added up."""
    m, v, q, s = p.momentum, p.volatility, p.volume, p.statistical
    back = max(m.stoch_k + m.stoch_d, m.williams, m.cci, m.roc, m.ao_slow, v.bollinger, v.donchian, v.historical, q.mfi + 1, q.vwma, q.cmf, s.window + 1, s.hurst + 1, s.entropy + 1, p.pattern.levels, 6)
    return back + 2, max(p.labels.max_return, p.labels.drawdown, *(k for _, k in p.labels.horizons))


def with_halos(rows: DataFrame, back: int, ahead: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (with __i and __n) and copies of them, with __block: every block has its own rows, ``back`` before and ``ahead`` after them."""
    last = F.floor((F.col("__n") - 1) / block_rows)
    first, end = F.greatest(F.floor((F.col("__i") - ahead) / block_rows), F.lit(0)), F.least(F.floor((F.col("__i") + back) / block_rows), last)
    return rows.withColumn("__block", F.explode(F.sequence(first, end)))


def own_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` without the copies of ``with_halos``."""
    return df.where(F.floor(F.col("__i") / block_rows) == F.col("__block"))


def long_windows(df: DataFrame, p: Params, keys: tuple = ("pair",)) -> DataFrame:
    """``df`` with Hurst exponent and entropy; groups are blocks with their halos."""

    def make(bars: pd.DataFrame, micros: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        c = bars["close"].to_numpy(float)
        runs = Runs(len(c), first)
        return {"hurst_exponent": hurst(c, p.statistical.hurst, p.statistical.hurst_max_lag, runs), "shannon_entropy": entropy(c, p.statistical.entropy, p.statistical.entropy_bins, runs)}

    return passed(df, keys, LONG, make)


def features_by_slot(bars: DataFrame, p: Params | None = None, groups: tuple = GROUPS, width: str = "30 days", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``bars`` with the columns of ``groups`` (of ``GROUPS``, and ``recursive``), equal to those of a full run by pair.

    width: of the time slots in which rows are numbered and sums run; block_rows: own rows of a block, at least the reach
    back. A task holds one block with its halos. The group ``recursive`` has no parabolic stop here: ``parabolic_by_pair`` adds it.
    No bars give no rows; a null pair is a pair.
    """
    p = p or Params()
    back, ahead = reach(p)
    if block_rows < back:
        raise ValueError(f"blocks of {block_rows} rows are shorter than the {back} rows that features look back")
    groups = tuple(g for g in GROUPS if g in groups or (g == "price_action" and "statistical" in groups)) + (("recursive",) if "recursive" in groups else ())
    scanned = tuple(c for c in slots.COLUMNS if ("volume" in groups if c in SUMS else "recursive" in groups))
    rows = slots.recursive_by_slot(bars, p, width, scanned) if scanned else bars
    # The window functions name the pair; here a pair's block stands for it.
    rows = with_halos(slots.numbered_by_slot(rows, width), back, ahead if "labels" in groups else 0, block_rows)
    rows = rows.withColumnRenamed("pair", "__pair").withColumn("pair", F.struct("__pair", "__block")).withColumnsRenamed({c: f"__kept_{c}" for c in scanned})
    for name in groups:
        if name != "recursive":
            rows = getattr(features, name)(rows, p)
    rows = rows.drop("pair", *SUMS)
    if "recursive" in groups:
        rows = long_windows(rows, p, ("__pair", "__block"))
    return own_rows(rows, block_rows).withColumnsRenamed({f"__kept_{c}": c for c in scanned} | {"__pair": "pair"}).drop("__i", "__n", "__block")


def parabolic_by_pair(df: DataFrame, p: Params | None = None) -> DataFrame:
    """``df`` with the parabolic stop, whose recursion branches on its state: the one column that needs a pair's history in one task."""
    return recursive(df, p, ("parabolic_sar_1h",))
