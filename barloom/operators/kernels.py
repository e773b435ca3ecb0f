"""Numpy kernels over series of pairs, stacked one after another, ascending in time.

Each takes the ``Runs`` of a stack; without them a series is one pair's.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd

#: Windows that are evaluated at once.
CHUNK = 4096


class Runs:
    """Where each pair's rows lie in a stack of n rows: ``first`` of them and ``size``; ``at`` and ``rows`` are each row's number in its run and the run's rows."""

    def __init__(self, n: int, first: np.ndarray | None = None) -> None:
        self.first = np.zeros(min(n, 1), int) if first is None else np.asarray(first, int)
        self.size = np.diff(self.first, append=n)
        self.at = np.arange(n) - np.repeat(self.first, self.size)
        self.rows = np.repeat(self.size, self.size)

    def before(self, x: np.ndarray, fill: float | np.ndarray, k: int = 1) -> np.ndarray:
        """``x`` k rows before, ``fill`` in a run's first k rows."""
        out = np.concatenate([x[:k], x[: max(0, len(x) - k)]])
        return np.where(self.at < k, fill, out)

    def scan(self, x: np.ndarray, go_on: Callable[[float, float], float]) -> np.ndarray:
        """Each run's first value, then ``go_on`` of the result before and the value."""
        values, out = x.tolist(), []
        for a, n in zip(self.first.tolist(), self.size.tolist(), strict=True):
            out.extend(accumulate(values[a : a + n], go_on))
        return np.array(out, float)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Running sums."""
        return self.scan(x, lambda y, v: y + v)

    def window(self, x: np.ndarray, n: int, fill: float) -> list[np.ndarray]:
        """``x`` n - 1 rows before to 0 rows before; ``fill`` beyond the run's first row."""
        return [self.before(x, fill, k) if k else x for k in range(n - 1, -1, -1)]

    def window_sum(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sums of the newest n rows, added up from the oldest: what left the window leaves no rounding behind."""
        return sum(self.window(x, n, 0.0))

    def window_std(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sample deviation of the newest n rows, 0 for one row."""
        k = np.minimum(self.at + 1, n)
        mean = self.window_sum(x, n) / k
        squares = sum((v - mean) ** 2 for v in (np.where(self.at >= n - 1 - j, v, mean) for j, v in enumerate(self.window(x, n, 0.0))))
        return np.sqrt(squares / np.maximum(k - 1, 1))


def ewm(x: np.ndarray, span: float) -> np.ndarray:
    """y0 = x0, then y = a x + (1 - a) y before, with a = 2 / (span + 1); a missing x keeps the y before."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def smooth(x: np.ndarray, span: float, runs: Runs | None = None) -> np.ndarray:
    """``ewm`` of a stack without missing values, term by term as the recursion states it: quotients by means next to 0 depend on the last bit."""
    a, b = 2 / (span + 1), (span - 1) / (span + 1)
    return (runs or Runs(len(x))).scan(x, lambda y, v: a * v + b * y)


def wilder(x: np.ndarray, n: int, seed_at: int, fill: float, runs: Runs | None = None) -> np.ndarray:
    """A mean of n values seeded at row ``seed_at`` with those up to it, then y = ((n - 1) y + x) / n."""
    runs = runs or Runs(len(x))
    seeded = runs.at >= seed_at
    y = np.where(runs.at == seed_at, runs.window_sum(x, n) / n, x)[seeded]
    out = np.full(len(x), fill)
    if len(y):
        out[seeded] = Runs(len(y), np.flatnonzero(runs.at[seeded] == seed_at)).scan(y, lambda y, v: ((n - 1) * y + v) / n)
    return out


def rsi(close: np.ndarray, n: int = 14, runs: Runs | None = None) -> np.ndarray:
    """Wilder's RSI from row n on, 50 before; 100 where there is no loss."""
    runs = runs or Runs(len(close))
    d = close - runs.before(close, close)
    up, down = wilder(np.maximum(d, 0), n, n, 0.0, runs), wilder(np.maximum(-d, 0), n, n, 0.0, runs)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(down > 0, 100 - 100 / (1 + up / down), 100.0)
    return np.where(runs.at < n, 50.0, out)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray, runs: Runs | None = None) -> np.ndarray:
    before = (runs or Runs(len(close))).before(close, np.nan)
    return np.fmax(high - low, np.fmax(abs(high - before), abs(low - before)))


def step(x: np.ndarray, k: int = 1, runs: Runs | None = None) -> np.ndarray:
    """(x - x k rows before) / k, 0 in the first k rows."""
    return (x - (runs or Runs(len(x))).before(x, x, k)) / k


def over(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=ok)


def parabolic_sar(high: np.ndarray, low: np.ndarray, close: np.ndarray, start: float, inc: float, most: float, runs: Runs | None = None) -> np.ndarray:
    """Stop-and-reverse: a state of stop, extreme, acceleration and direction."""
    runs = runs or Runs(len(close))
    out = np.zeros(len(close))
    for a, n in zip(runs.first.tolist(), runs.size.tolist(), strict=True):
        if n > 1:
            out[a : a + n] = _sar(*(x[a : a + n].tolist() for x in (high, low, close)), start, inc, most)
    return out


def _sar(high: list, low: list, close: list, start: float, inc: float, most: float) -> list:
    rising = close[1] > close[0]
    stop, extreme = (low[0], high[0]) if rising else (high[0], low[0])
    pace, out = start, [stop]
    for i in range(1, len(close)):
        stop += pace * (extreme - stop)
        j = max(i - 2, 0)
        stop = min(stop, low[i - 1], low[j]) if rising else max(stop, high[i - 1], high[j])
        if low[i] < stop if rising else high[i] > stop:
            rising, stop, pace = not rising, extreme, start
            extreme = high[i] if rising else low[i]
        elif high[i] > extreme if rising else low[i] < extreme:
            extreme, pace = (high[i] if rising else low[i]), min(pace + inc, most)
        out.append(stop)
    return out


def _windows(close: np.ndarray, n: int, runs: Runs):
    """(rows, log returns of the n closes before each of them) in chunks of the rows that have so many before them."""
    r = np.diff(np.log(np.maximum(close, 1e-8)))
    rows = np.flatnonzero(runs.at >= n)
    if len(rows):
        view = np.lib.stride_tricks.sliding_window_view(r, n - 1)
        for at in range(0, len(rows), CHUNK):
            yield rows[at : at + CHUNK], view[rows[at : at + CHUNK] - n]


def hurst(close: np.ndarray, n: int, max_lag: int, runs: Runs | None = None) -> np.ndarray:
    """Half the slope of log RMS lagged difference on log lag, within [0, 1]; 0.5 if there is no slope, 0 before row n."""
    runs = runs or Runs(len(close))
    out = np.where(runs.rows < n, 0.5, 0.0)
    for at, r in _windows(close, n, runs):
        y = np.column_stack([np.sqrt(np.mean((r[:, k:] - r[:, :-k]) ** 2, axis=1)) for k in range(1, max_lag + 1)])
        ok = y > 1e-12  # less is rounding of equal returns
        x = np.where(ok, np.log(np.arange(1, max_lag + 1.0)), 0.0)
        y = np.where(ok, np.log(np.where(ok, y, 1.0)), 0.0)
        m = ok.sum(axis=1)
        mean = lambda a, m=m: (a.sum(axis=1) / np.maximum(m, 1))[:, None]
        dx = np.where(ok, x - mean(x), 0.0)
        dy = np.where(ok, y - mean(y), 0.0)
        size = (dx * dx).sum(axis=1)
        slope = over((dx * dy).sum(axis=1), size, size > 0)
        out[at] = np.where((m > 1) & (size > 0), np.clip(slope / 2, 0.0, 1.0), 0.5)
    return out


def entropy(close: np.ndarray, n: int, bins: int, runs: Runs | None = None) -> np.ndarray:
    """Shannon entropy (nats) of the returns' histogram of equal bins from least to greatest; 0 before row n."""
    out = np.zeros(len(close))
    for at, r in _windows(close, n, runs or Runs(len(close))):
        low = r.min(axis=1, keepdims=True)
        width = np.maximum(r.max(axis=1, keepdims=True) - low, 1e-8)
        place = np.clip(((r - low) / width * bins).astype(int), 0, bins - 1)
        share = np.stack([(place == b).sum(axis=1) for b in range(bins)]) / r.shape[1]
        out[at] = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=0)
    return out
