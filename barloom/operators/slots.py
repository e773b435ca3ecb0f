"""A pair's history cut by time: row numbers, recursive means and running sums without a pair in one task.

Rows are dealt by pair and time slot. What a slot must know of those before it is small and is composed in
order, over a table of one row a slot:

* its first row's number and the row before it (``slot_heads``), from counts and last rows;
* the state that recursive columns have there (``slot_states``). All of them are affine in the state before:
  a slot of n rows maps the state s to A s + b. b is what its rows give from a state of zeros, in one compiled pass a
  column; A is the n-th power of the matrix of one row, whose rows for nested means (a signal of a difference of
  means, a mean of a mean) are not diagonal. Wilder's means are seeded by plain sums, so their factors are those of
  the rows before, at and after the seed. Running sums have factor 1, and 0 where they start anew.

Then each slot is filled from its start state. A prefix of maps is associative; here the few maps of a pair
are composed by one group, whose rows are the pair's slots, not its bars.

The parabolic stop-and-reverse is no affine map (its branches depend on the state), so it stays in the pass by pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.params import Params

from .kernels import over

#: States, in the order of their vectors. Fixed: the matrix of one row and the slot table follow it.
STATES = (
    "up", "down", "macd_fast", "macd_slow", "macd_signal", "drive_fast", "drive", "size_fast", "size", "ppo_fast", "ppo_slow",
    "atr", "chaikin", "klinger_fast", "klinger_slow", "volume_fast", "volume_slow", "rose", "fell", "vzo", "obv", "vpt",
)
#: Columns that are filled from states.
COLUMNS = (
    "rsi_1h", "rsi_slope_1h", "macd_slope_1h", "macd_hist_slope_1h", "tsi", "ppo", "atr_1h", "normalized_atr_14", "keltner_channel_width",
    "chaikin_volatility", "klinger_oscillator", "volume_oscillator", "volume_zone_oscillator", "obv_1h", "obv_slope_1h", "volume_price_trend",
)
#: Rows before a slot that its columns look back to: slopes over three rows.
TAIL = 3
_AT = {name: k for k, name in enumerate(STATES)}


def slot_of(width: str) -> Column:
    """The number of a row's time slot of ``width`` (days or shorter units), counted from the epoch."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    zero = F.timestamp_seconds(F.lit(0))
    return F.floor(micros(F.col("timestamp_utc")) / micros(zero + F.expr(f"interval {width}"))).cast("long").alias("__slot")


def slot_heads(bars: DataFrame) -> DataFrame:
    """(pair, __slot, __rows, __start, __n, before_high, _low, _close, _volume): each slot's rows, its first row's number, the pair's rows, and the row before.

    bars has pair, timestamp_utc, high, low, close, volume and __slot. Windows here are over slots, of which a pair has few.
    """
    last = F.max_by(F.struct("high", "low", "close", "volume"), "timestamp_utc").alias("last")
    slots = bars.groupBy("pair", "__slot").agg(F.count(F.lit(1)).alias("__rows"), last)
    order = Window.partitionBy("pair").orderBy("__slot")
    start = F.coalesce(F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start")
    before = F.lag("last").over(order)
    return slots.select("pair", "__slot", "__rows", start, F.sum("__rows").over(Window.partitionBy("pair")).alias("__n"), *(before[c].alias(f"before_{c}") for c in ("high", "low", "close", "volume")))


def same_slot(a: DataFrame, b: DataFrame) -> Column:
    return a["pair"].eqNullSafe(b["pair"]) & (a["__slot"] == b["__slot"])


def numbered_by_slot(bars: DataFrame, width: str = "30 days") -> DataFrame:
    """``bars`` with __i (the row's number in its pair, from 0) and __n (the pair's rows), numbered a slot at a time."""
    rows = bars.withColumn("__slot", slot_of(width))
    heads = slot_heads(rows)
    own = Window.partitionBy(rows["pair"], rows["__slot"]).orderBy("timestamp_utc")
    both = rows.join(heads, same_slot(rows, heads))
    return both.select(*(rows[c] for c in bars.columns), (F.col("__start") + F.row_number().over(own) - 1).alias("__i"), "__n")


def _ewm(x: np.ndarray, span: float, before: float | None) -> np.ndarray:
    """An exponential mean that goes on from ``before``, or starts with the first value."""
    x = x if before is None else np.concatenate([[before], x])
    y = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
    return y if before is None else y[1:]


def _wilder(x: np.ndarray, n: int, seed_at: int, i0: int, before: float) -> np.ndarray:
    """Wilder's mean of rows i0 and on: a plain sum before row ``seed_at``, their mean there, then ((n - 1) y + x) / n."""
    k = int(np.clip(seed_at - i0, 0, len(x)))
    out = np.cumsum(np.concatenate([[before], x[:k]]))[1:]
    rest = x[k:]
    if not len(rest):
        return out
    y0 = out[-1] if k else before
    if i0 + k == seed_at:  # the first of the rest is the seed
        rest = np.concatenate([[(y0 + rest[0]) / n], rest[1:]])
        return np.concatenate([out, pd.Series(rest).ewm(alpha=1 / n, adjust=False).mean().to_numpy()])
    return np.concatenate([out, pd.Series(np.concatenate([[y0], rest])).ewm(alpha=1 / n, adjust=False).mean().to_numpy()[1:]])


def _inputs(bars: pd.DataFrame, before: dict | None) -> dict[str, np.ndarray]:
    """What the recursions take from each row and the row before it; ``before`` is None at a pair's first row."""
    h, lo, c, v = (bars[k].to_numpy(float) for k in ("high", "low", "close", "volume"))
    ph, pl, pc, pv = (np.concatenate([[x[0] if before is None else before[k]], x[:-1]]) for k, x in (("high", h), ("low", lo), ("close", c), ("volume", v)))
    dc = c - pc
    first = np.zeros(len(c), bool)
    first[0] = before is None
    tr = np.where(first, h - lo, np.maximum(h - lo, np.maximum(abs(h - pc), abs(lo - pc))))
    inside = over((c - lo) - (h - c), h - lo, h > lo)
    force = v * np.where(h + lo + c - (ph + pl + pc) > 0, 1.0, -1.0) * abs(inside) * 2
    return {
        "close": c, "dc": dc, "tr": tr, "span": h - lo, "volume": v, "force": np.where(first, 0.0, force),
        "rose": np.where(first, 0.0, v * (dc > 0)), "fell": np.where(first, 0.0, v * (dc <= 0)),
        "signed": np.where(first, v, np.sign(dc) * v), "trend": np.where(first, 0.0, v * over(dc, pc, pc > 0)), "anew": ~first & (pc <= 0),
    }


def _run(u: dict[str, np.ndarray], p: Params, i0: int, s: np.ndarray | None) -> np.ndarray:
    """The states after each row (rows by states), from row number i0 with the state s before it; s is None at a pair's start."""
    m, va, q = p.momentum, p.volatility, p.volume
    at = lambda name: None if s is None else s[_AT[name]]
    c, dc, v = u["close"], u["dc"], u["volume"]
    out: dict[str, np.ndarray] = {}

    def mean(name: str, x: np.ndarray, span: float) -> np.ndarray:
        out[name] = _ewm(x, span, at(name))
        return out[name]

    zero = lambda name: 0.0 if s is None else s[_AT[name]]
    out["up"] = _wilder(np.maximum(dc, 0), m.rsi, m.rsi, i0, zero("up"))
    out["down"] = _wilder(np.maximum(-dc, 0), m.rsi, m.rsi, i0, zero("down"))
    mean("macd_signal", mean("macd_fast", c, m.macd_fast) - mean("macd_slow", c, m.macd_slow), m.macd_signal)
    mean("drive", mean("drive_fast", dc, m.tsi_fast), m.tsi_slow)
    mean("size", mean("size_fast", abs(dc), m.tsi_fast), m.tsi_slow)
    mean("ppo_fast", c, m.ppo_fast), mean("ppo_slow", c, m.ppo_slow)
    out["atr"] = _wilder(u["tr"], va.atr, va.atr - 1, i0, zero("atr"))
    mean("chaikin", u["span"], va.chaikin)
    mean("klinger_fast", u["force"], q.klinger_fast), mean("klinger_slow", u["force"], q.klinger_slow)
    mean("volume_fast", v, q.oscillator_fast), mean("volume_slow", v, q.oscillator_slow)
    mean("rose", u["rose"], q.vzo), mean("fell", u["fell"], q.vzo), mean("vzo", v, q.vzo)
    out["obv"] = zero("obv") + np.cumsum(u["signed"])
    out["vpt"] = _sums(u["trend"], u["anew"], zero("vpt"))
    return np.column_stack([out[name] for name in STATES])


def _sums(x: np.ndarray, anew: np.ndarray, before: float) -> np.ndarray:
    """Running sums that start at 0 again in each row marked ``anew``."""
    part = np.cumsum(anew)
    y = pd.Series(x).groupby(part).cumsum().to_numpy()
    return y + np.where(part == 0, before, 0.0)


def row_matrix(p: Params) -> np.ndarray:
    """The linear part of one row after all seeds: column k is what a state of 1 in k and nothing else leads to."""
    nothing = {k: np.zeros(1, bool if k == "anew" else float) for k in ("close", "dc", "tr", "span", "volume", "force", "rose", "fell", "signed", "trend", "anew")}
    late = 10 + max(p.momentum.rsi, p.volatility.atr)
    return np.column_stack([_run(nothing, p, late, row)[0] for row in np.eye(len(STATES))])


def _factors(p: Params, i0: int, rows: int, starts_anew: bool) -> dict[str, float]:
    """Linear parts that depend on row numbers or rows, of the first ``rows`` rows from number i0: Wilder's means and the running sum."""
    out = {"vpt": 0.0 if starts_anew else 1.0}
    for name, n, seed_at in (("up", p.momentum.rsi, p.momentum.rsi), ("down", p.momentum.rsi, p.momentum.rsi), ("atr", p.volatility.atr, p.volatility.atr - 1)):
        seeded = i0 <= seed_at < i0 + rows
        after = max(0, i0 + rows - max(seed_at + 1, i0))
        out[name] = (1 / n if seeded else 1.0) * ((n - 1) / n) ** after
    return out


def affine(powers: Callable[[int], np.ndarray], p: Params, i0: int, rows: int, starts_anew: bool) -> np.ndarray:
    """The linear part A of the map of ``rows`` rows from number i0."""
    a = powers(rows).copy()
    for name, x in _factors(p, i0, rows, starts_anew).items():
        a[_AT[name]] = 0.0
        a[_AT[name], _AT[name]] = x
    return a


def _before(head: pd.DataFrame) -> dict | None:
    """The row before a slot, None at the pair's start."""
    return None if head["__start"].iloc[0] == 0 else {c: float(head[f"before_{c}"].iloc[0]) for c in ("high", "low", "close", "volume")}


def states_of(bars: pd.DataFrame, before: dict | None, i0: int, tail: np.ndarray, p: Params) -> np.ndarray:
    """The states after each of consecutive bars (rows by ``STATES``), from those before them."""
    return _run(_inputs(bars, before), p, i0, tail[-1] if len(tail) else None)


def slot_maps(rows: DataFrame, heads: DataFrame, p: Params) -> DataFrame:
    """(pair, __slot, tail, anew): what each slot's last rows give from a state of zeros, and which of them a running sum has started anew by."""

    kind = T.StructType([*rows.select("pair", "__slot").schema.fields, *T._parse_datatype_string("tail array<double>, anew array<boolean>").fields])

    def reduce(key: tuple, bars: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp_utc", kind="stable")
        u, i0 = _inputs(bars, _before(head)), int(head["__start"].iloc[0])
        y = _run(u, p, i0, None if i0 == 0 else np.zeros(len(STATES)))
        anew = np.cumsum(u["anew"])[-TAIL:] > 0
        return pd.DataFrame({"pair": [key[0]], "__slot": [key[1]], "tail": [y[-TAIL:].ravel()], "anew": [anew.tolist()]})

    keys = ("pair", "__slot")
    return rows.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(reduce, kind)


def slot_states(maps: DataFrame, heads: DataFrame, p: Params) -> DataFrame:
    """``heads`` with ``states``: the states of up to ``TAIL`` rows before each slot, oldest first; empty at a pair's start."""
    one = row_matrix(p)

    def compose(slots: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values("__slot", kind="stable")
        known: dict[int, np.ndarray] = {}

        def powers(n: int) -> np.ndarray:
            if n not in known:
                known[n] = np.linalg.matrix_power(one, n)
            return known[n]

        tail, found = np.zeros((0, len(STATES))), []
        for start, n, y, anew in zip(slots["__start"], slots["__rows"], slots["tail"], slots["anew"], strict=True):
            found.append(tail.ravel())
            own = np.asarray(y, float).reshape(-1, len(STATES))
            if len(tail):
                ends = range(int(n) - len(own) + 1, int(n) + 1)
                own = own + np.stack([affine(powers, p, int(start), k, bool(a)) @ tail[-1] for k, a in zip(ends, anew, strict=True)])
            tail = np.concatenate([tail, own])[-TAIL:]
        return slots.drop(columns=["tail", "anew"]).assign(states=found)

    both = heads.join(maps, same_slot(heads, maps)).select(*(heads[c] for c in heads.columns), "tail", "anew")
    return both.groupBy("pair").applyInPandas(compose, T.StructType([*heads.schema.fields, T.StructField("states", T.ArrayType(T.DoubleType()))]))


def fill(bars: pd.DataFrame, before: dict | None, i0: int, n: int, tail: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """``COLUMNS`` of consecutive bars, ascending in time, from row number i0 of a pair of n rows.

    before is the row before them and tail the states of up to ``TAIL`` rows before them, oldest first; None and empty at the pair's start.
    """
    m, va = p.momentum, p.volatility
    y = np.concatenate([tail, states_of(bars, before, i0, tail, p)])
    k = len(tail)
    i = np.arange(i0 - k, i0 + len(bars))
    s = {name: y[:, at] for name, at in _AT.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        rs = np.where(i < m.rsi, 50.0, np.where(s["down"] > 0, 100 - 100 / (1 + s["up"] / s["down"]), 100.0))
    back = lambda x, j: np.concatenate([np.full(min(j, len(x)), np.nan), x[: max(0, len(x) - j)]])
    slope = lambda x, j: np.where(i >= j, (x - back(x, j)) / j, 0.0)
    macd = s["macd_fast"] - s["macd_slow"]
    atr = np.where((i >= va.atr - 1) & (n > va.atr), s["atr"], 0.0)
    c = np.concatenate([np.ones(k), bars["close"].to_numpy(float)])
    out = {
        "rsi_1h": rs, "rsi_slope_1h": slope(rs, 3), "macd_slope_1h": slope(macd, 1), "macd_hist_slope_1h": slope(macd - s["macd_signal"], 1),
        "tsi": 100 * over(s["drive"], s["size"], s["size"] != 0), "ppo": 100 * over(s["ppo_fast"] - s["ppo_slow"], s["ppo_slow"], s["ppo_slow"] > 0),
        "atr_1h": atr, "normalized_atr_14": over(atr, c, c > 0), "keltner_channel_width": 2 * va.keltner_width * atr,
        "chaikin_volatility": np.where(i > 0, s["chaikin"] / np.maximum(back(s["chaikin"], 1), 1e-8) - 1, 0.0),
        "klinger_oscillator": s["klinger_fast"] - s["klinger_slow"], "volume_oscillator": s["volume_fast"] - s["volume_slow"],
        "volume_zone_oscillator": 100 * over(s["rose"] - s["fell"], s["vzo"], s["vzo"] > 0),
        "obv_1h": s["obv"], "obv_slope_1h": slope(s["obv"], 3), "volume_price_trend": s["vpt"],
    }
    return {name: x[k:] for name, x in out.items()}


def recursive_by_slot(bars: DataFrame, p: Params | None = None, width: str = "30 days", columns: tuple = COLUMNS) -> DataFrame:
    """``bars`` with ``columns`` of ``COLUMNS``, equal to those of the pass by pair; no task holds more than a slot of a pair.

    width: of a time slot; a slot's rows are one group. Other columns pass through. Times within a pair are unique; a null
    pair is a pair; no bars give no rows. Prices are not null, as in the pass by pair.
    """
    p = p or Params()
    kept = [c for c in bars.columns if c not in columns]
    rows = bars.select(*kept, slot_of(width))
    thin = rows.select("pair", "__slot", "timestamp_utc", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    heads = slot_heads(thin)
    states = slot_states(slot_maps(thin, heads, p), heads, p)

    def run(key: tuple, own: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("timestamp_utc", kind="stable")
        tail = np.asarray(head["states"].iloc[0], float).reshape(-1, len(STATES))
        made = fill(own, _before(head), int(head["__start"].iloc[0]), int(head["__n"].iloc[0]), tail, p)
        return pd.concat([own.drop(columns="__slot"), pd.DataFrame({c: made[c] for c in columns}, index=own.index)], axis=1)

    schema = T.StructType([*bars.select(*kept).schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    keys = ("pair", "__slot")
    return rows.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(run, schema)
