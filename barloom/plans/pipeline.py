"""The registry of feature groups, and full and rolling computation over all pairs at once.

Window groups share one shuffle and sort on the pair; one grouped Arrow pass on the same dealing computes
recursive columns and higher frames; cross-section ranks take the second shuffle, on time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import numbered
from barloom.operators import features
from barloom.operators.cross_pair import cross_pair
from barloom.operators.multi_timeframe import MTF, multi_timeframe
from barloom.operators.recursive import COLUMNS, grouped_pass, recursive
from barloom.params import Params
from barloom.sources.candles import latest

Group = Callable[[DataFrame, Params], DataFrame]

#: Groups in order; a user's own group is added with ``register``.
GROUPS: dict[str, Group] = {
    "price_action": features.price_action,
    "momentum": features.momentum,
    "volatility": features.volatility,
    "volume": features.volume,
    "statistical": features.statistical,
    "pattern": features.pattern,
    "calendar": features.calendar,
    "labels": features.labels,
    "recursive": recursive,
    "multi_timeframe": multi_timeframe,
    "cross_pair": cross_pair,
}
#: Groups that are grouped Arrow passes, and their columns.
PASSES = {"recursive": (recursive, COLUMNS), "multi_timeframe": (multi_timeframe, MTF)}
NEEDS = {"statistical": {"price_action"}, "cross_pair": {"price_action", "labels", "recursive"}}


def register(name: str, group: Group, needs: set[str] | None = None) -> None:
    """Add a feature group, run after those before it."""
    GROUPS[name] = group
    NEEDS[name] = set(needs or ())


def compute_features(bars: DataFrame, params: Params | None = None, groups: list[str] | None = None, added: dict[str, str] | None = None) -> DataFrame:
    """``bars`` with the columns of ``groups`` (default all that are not disabled) and what those need.

    added, if given, receives the group of each new column.
    """
    params = params or Params()
    wanted = set(groups if groups is not None else GROUPS) - params.disabled
    for name in list(wanted):
        wanted |= NEEDS.get(name, set())
    df = numbered(bars)
    grouped = [name for name in PASSES if name in wanted and GROUPS[name] is PASSES[name][0]]
    for name, group in GROUPS.items():
        if name not in wanted or name in grouped[1:]:
            continue
        before = set(df.columns)
        if name in grouped:  # all grouped passes as one
            df = grouped_pass(df, params, tuple(c for g in grouped for c in PASSES[g][1]))
        else:
            df = group(df, params)
        if added is not None:
            added |= {c: next((g for g in grouped if name in grouped and c in PASSES[g][1]), name) for c in df.columns if c not in before}
    return df.drop("__i", "__n")


def full_backfill(bars: DataFrame, params: Params | None = None) -> DataFrame:
    """All features of all bars."""
    return compute_features(bars, params)


def rolling_update(bars: DataFrame, params: Params | None = None, groups: list[str] | None = None) -> DataFrame:
    """Features of each pair's newest ``rolling`` bars, from these and ``look_back`` bars before them.

    Window features equal those of a full run; recursive ones restart where the read begins and differ
    there by what their memory of older bars would add.
    """
    params = params or Params()
    made = compute_features(latest(bars, params.rolling + params.look_back), params, groups)
    return latest(made, params.rolling)


def feature_columns(df: DataFrame) -> list[str]:
    """Columns of ``df`` that are neither keys nor raw bars."""
    return [c for c in df.columns if c not in ("pair", "timestamp_utc", "open", "high", "low", "close", "volume")]


#: Digits of columns whose quotients often end in a five at the seventh place, or whose sums are large.
DIGITS = {"vwma_20": 8, "future_risk_adj_return_12h": 7, "volume_price_trend": 3}


def rounded(c: str, digits: int) -> Column:
    """A double rounded half away from zero as the SQL rounds it: the scaled double, not its decimal text. Infinities and NaN stay; -0.0 is 0.0."""
    scaled = F.col(c) * 10.0**digits
    whole = F.rint(scaled)
    whole = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits + 0.0).otherwise(F.col(c))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded to ``digits``: sums in another order then compare equal."""
    return df.select(*(rounded(c, DIGITS.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))
