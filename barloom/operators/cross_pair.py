"""Cross-section features: ranks among the pairs of one time, and correlation with a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import at_time, by_pair, rounded_short
from barloom.params import CrossPair, Params


def percent_rank_of(c: Column | str, positive_only: bool = True) -> Column:
    """0 to 100 among the rows of one time, ties averaged, rounded half to even.

    One row: 50. If no value is above 0 and ``positive_only``: 50.
    """
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(F.lit(1)).over(at_time())
    # The first and the last place of a tie, from both ends: both windows are dealt by time alone.
    up, down = F.rank().over(at_time().orderBy(c.asc_nulls_first())), F.rank().over(at_time().orderBy(c.desc_nulls_last()))
    place = (up + n - down - 1) / 2
    rank = F.when(n == 1, 50.0).otherwise(100 * place / (n - 1))
    if positive_only:
        rank = F.when(F.max(c).over(at_time()) > 0, rank).otherwise(50.0)
    return rounded_short(rank)


def benchmark(pair: str, c: str) -> Column:
    """The value of ``c`` that ``pair`` has at the row's time; null if it has no row."""
    return F.max(F.when(F.col("pair") == pair, F.col(c))).over(at_time())


def relative_rank(name: str, pair: str, c: str = "future_return_1h_pct") -> Column:
    """Rank of a return against a benchmark's, 0 where the benchmark has none or stands alone."""
    b = F.col(f"__{name}")
    against = F.when(F.abs(b) > 1e-9, (F.col(c) - b) / F.abs(b))
    n = F.count(F.lit(1)).over(at_time())
    return F.when((F.abs(b) > 1e-9) & (n > 1), percent_rank_of(against, positive_only=False)).otherwise(F.lit(0).cast("smallint"))


def cross_pair(df: DataFrame, p: Params | None = None) -> DataFrame:
    """``df`` with volume, volatility and performance ranks, and 24-row correlation with the benchmark.

    Needs atr_1h, log_return, future_return_1h_pct and volume. The correlation is over the previous rows
    that both pairs have; the benchmark itself has 1; rows before the full window have 0.
    """
    q = p.cross_pair if p else CrossPair()
    df = df.withColumns({"__btc": benchmark(q.btc, "future_return_1h_pct"), "__eth": benchmark(q.eth, "future_return_1h_pct"), "__base": benchmark(q.btc, "log_return")})
    df = df.withColumns({
        "volume_rank_1h": percent_rank_of("volume"),
        "volatility_rank_1h": percent_rank_of("atr_1h"),
        "performance_rank_btc_1h": relative_rank("btc", q.btc),
        "performance_rank_eth_1h": relative_rank("eth", q.eth),
    })
    shared = Window.partitionBy("pair", F.col("__base").isNull()).orderBy("timestamp_utc")
    prior = shared.rowsBetween(-q.correlation, -1)
    # Moments rather than corr(): constant series then give 0, not a quotient of rounding.
    x, y = F.col("log_return"), F.col("__base")
    cov, vx, vy = F.covar_pop(x, y).over(prior), F.var_pop(x).over(prior), F.var_pop(y).over(prior)
    full = F.count(F.lit(1)).over(prior) == q.correlation
    corr = F.when(F.col("__base").isNotNull() & full & (vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy))
    # The window on the pair comes first: the finer one below is then served by the same dealing.
    df = df.withColumn("prev_volume_rank", F.coalesce(F.lag("volume_rank_1h").over(by_pair()), F.lit(0)).cast("double"))
    df = df.withColumn("btc_corr_24h", F.when(F.col("pair") == q.btc, 1.0).otherwise(F.coalesce(corr, F.lit(0.0))))
    return df.drop("__btc", "__eth", "__base")
