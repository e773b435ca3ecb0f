"""State kept by key in a stream: features of arriving bars, and hours that go out when they are complete.

Both are ``transformWithStateInPandas`` processors on the RocksDB state store, so state may exceed memory and
comes back after a failure from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.kernels import entropy, hurst
from barloom.operators.slots import COLUMNS, STATES, TAIL, fill, states_of
from barloom.params import Params

#: Columns that ``feature_stream`` keeps: recursive ones, running sums, and those of long windows.
KEPT = (*COLUMNS, "hurst_exponent", "shannon_entropy")
#: A bar may come late by so many rows of its pair; so many are held in state, and those that the oldest of them looks back to.
HELD = 512
_BAR = ("t", "open", "high", "low", "close", "volume")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and list states need; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FeatureKeeper(StatefulProcessor):
    """A pair's newest bars and, of the row before them, its number and the recursive states.

    Arriving bars are put in their place, a bar of a known time replaces it; features are computed anew from the oldest change
    to the newest bar and go out. Then the oldest bars beyond ``held`` leave, and the states move on past them.
    """

    def __init__(self, p: Params, held: int) -> None:
        self.p, self.back = p, max(p.statistical.hurst, p.statistical.entropy)
        self.held = held + self.back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "t long, open double, high double, low double, close double, volume double")
        self.head = handle.getValueState("head", "start long, before array<double>, tail array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat([r[list(_BAR)] for r in rows]).sort_values(list(_BAR), kind="stable").drop_duplicates("t", keep="last")
        old = pd.DataFrame(list(self.bars.get()), columns=list(_BAR))
        start, before, tail = self.head.get() if self.head.exists() else (0, [], [])
        tail = np.asarray(list(tail), float).reshape(-1, len(STATES))
        before = dict(zip(("high", "low", "close", "volume"), before, strict=True)) if start else None
        # The oldest held bars are there to be looked back to; once others have left before them, they do not change.
        too_late = came["t"] <= old["t"].iloc[self.back - 1] if start else np.zeros(len(came), bool)
        lost, came = came[too_late], came[~too_late]
        out = [self._shape(key, lost, {c: np.full(len(lost), np.nan) for c in KEPT})] if len(lost) else []
        if len(came):
            bars = pd.concat([old, came]) if len(old) else came
            bars = bars.drop_duplicates("t", keep="last").sort_values("t").reset_index(drop=True)
            n, then = start + len(bars), start + len(old)
            made = fill(bars, before, start, n, tail, self.p)
            c, q = bars["close"].to_numpy(float), self.p.statistical
            made["hurst_exponent"], made["shannon_entropy"] = hurst(c, q.hurst, q.hurst_max_lag), entropy(c, q.entropy, q.entropy_bins)
            grown = any(then <= least < n for least in (self.p.volatility.atr, q.hurst - 1))  # warm-up rows change with the pair's length
            fresh = np.ones(len(bars), bool) if grown else bars["t"].to_numpy() >= came["t"].min()
            out.append(self._shape(key, bars[fresh], {k: x[fresh] for k, x in made.items()}))
            self._keep(bars, before, start, tail)
        if out:
            yield pd.concat(out)

    def _keep(self, bars: pd.DataFrame, before: dict | None, start: int, tail: np.ndarray) -> None:
        gone = max(0, len(bars) - self.held)
        if gone:
            tail = np.concatenate([tail, states_of(bars[:gone], before, start, tail, self.p)])[-TAIL:]
            before = bars.loc[gone - 1, ["high", "low", "close", "volume"]].astype(float).to_dict()
        kept = bars[gone:]
        self.bars.put([(int(t), *map(float, rest)) for t, *rest in kept.itertuples(index=False)])
        self.head.update((start + gone, list(before.values()) if before else [], [float(x) for x in tail.ravel()]))

    def _shape(self, key, bars: pd.DataFrame, made: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"pair": [key[0]] * len(bars), **{c: bars[c].to_numpy() for c in _BAR}, **{c: made[c] for c in KEPT}})

    def close(self) -> None:
        pass


def feature_stream(bars: DataFrame, p: Params | None = None, held: int = HELD) -> DataFrame:
    """A stream of bars (pair, timestamp_utc, open to volume) with the columns ``KEPT``; a row goes out again when its values change.

    The newest version of each row equals what a batch run over all bars gives, if no bar comes later than the ``held`` newest
    of its pair; such a bar goes out with NaN in all columns, for ``affected_tail`` to recompute from the store.
    """
    t = F.unix_micros(F.col("timestamp_utc").cast("timestamp")).alias("t")
    rows = bars.select("pair", t, *(F.col(c).cast("double").alias(c) for c in _BAR[1:]))
    schema = "pair string, t long, " + ", ".join(f"{c} double" for c in (*_BAR[1:], *KEPT))
    made = rows.groupBy("pair").transformWithStateInPandas(FeatureKeeper(p or Params(), held), schema, "Update", "None")
    return made.select("pair", F.timestamp_micros("t").alias("timestamp_utc"), *_BAR[1:], *KEPT)


class HourKeeper(StatefulProcessor):
    """The pairs whose bar of an hour has come, until the hour goes out; then only that it has."""

    def __init__(self, expected: int, hour_ms: int, wait_ms: int, keep_ms: int) -> None:
        self.expected, self.hour_ms, self.wait_ms, self.keep_ms = expected, hour_ms, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "pair string", "at long")
        self.done = handle.getValueState("done", "bars long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour, now = int(key[0]), timerValues.getCurrentWatermarkInMs()
        deadline = hour + self.hour_ms + self.wait_ms
        if self.done.exists() or now >= deadline:
            return  # out already, or its timer is due in this batch
        known = {k[0] for k in self.seen.keys()}  # noqa: SIM118
        if not known:
            self.handle.registerTimer(deadline)
        for pair in pd.concat(list(rows))["pair"].dropna().unique():
            if pair not in known:
                known.add(pair)
                self.seen.updateValue((pair,), (now,))
        if len(known) >= self.expected:
            self.handle.deleteTimer(deadline)
            yield self._release(hour, len(known), "complete")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour = int(key[0])
        if self.done.exists():  # the hour is so old that none of its bars is let in any more
            self.done.clear()
            return
        n = sum(1 for _ in self.seen.keys())  # noqa: SIM118
        if n:
            yield self._release(hour, n, "deadline")

    def _release(self, hour: int, bars: int, reason: str) -> pd.DataFrame:
        self.seen.clear()
        self.done.update((bars,))
        self.handle.registerTimer(hour + self.hour_ms + self.wait_ms + self.keep_ms)
        return pd.DataFrame({"ms": [hour], "bars": [bars], "reason": [reason]})

    def close(self) -> None:
        pass


def release_hours(bars: DataFrame, expected: int = 300, late: str = "10 minutes", wait_ms: int = 0, keep_ms: int = 86_400_000, hour_ms: int = 3_600_000) -> DataFrame:
    """(hour, bars, reason): each hour of a stream once, when ``expected`` pairs have a bar of it or its deadline passes.

    bars has pair and ts. reason is ``complete`` or ``deadline``; the deadline is ``wait_ms`` after the hour's end, in event time: it
    passes when the watermark, ``late`` behind the newest ts, does. Rows that come after the watermark change nothing; an hour without
    bars has no row. State holds an hour's pairs until it goes out, and for ``keep_ms`` that it did. Repeated bars count once, null pairs not.
    """
    ts = F.col("ts").cast("timestamp")
    rows = bars.select("pair", ts.alias("ts")).withWatermark("ts", late)
    ms = (F.floor(F.unix_millis("ts") / hour_ms) * hour_ms).cast("long").alias("ms")
    out = rows.select("pair", "ts", ms).groupBy("ms").transformWithStateInPandas(HourKeeper(expected, hour_ms, wait_ms, keep_ms), "ms long, bars long, reason string", "Update", "EventTime")
    return out.select(F.timestamp_millis("ms").alias("hour"), "bars", "reason")
