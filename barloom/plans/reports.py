"""Market summary, movers and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import by_pair
from barloom.operators.multi_timeframe import resample


def market_summary(bars: DataFrame) -> DataFrame:
    """(pair, close, previous_close, change_pct, volume) of each pair's last two daily bars."""
    newest = Window.partitionBy("pair").orderBy(F.desc("timestamp_utc"))
    days = resample(bars, "1 day").withColumn("k", F.row_number().over(newest)).where("k <= 2")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = days.groupBy("pair").agg(pick("close", 1).alias("close"), pick("close", 2).alias("previous_close"), pick("volume", 1).alias("volume"))
    return out.withColumn("change_pct", F.when(F.col("previous_close") > 0, 100 * (F.col("close") / F.col("previous_close") - 1)))


def movers(summary: DataFrame, k: int = 5) -> DataFrame:
    """(board, place, pair, score): the k largest gains, losses and volumes; each board a top-k, not a sort."""
    boards = []
    for board, score in (("gainers", F.col("change_pct")), ("losers", -F.col("change_pct")), ("volume", F.col("volume"))):
        top = summary.where(score.isNotNull()).select("pair", score.alias("score")).orderBy(F.desc("score"), "pair").limit(k)
        boards.append(top.select(F.lit(board).alias("board"), F.row_number().over(Window.orderBy(F.desc("score"), "pair")).alias("place"), "pair", "score"))
    return boards[0].unionByName(boards[1]).unionByName(boards[2])


def alerts(df: DataFrame, high: float = 70.0, low: float = 30.0) -> DataFrame:
    """(pair, timestamp_utc, rsi_alert, macd_cross) of rows with an alert; df has rsi_1h and macd_hist."""
    before = F.lag("macd_hist").over(by_pair())
    out = df.withColumns({
        "rsi_alert": F.when(F.col("rsi_1h") > high, "overbought").when(F.col("rsi_1h") < low, "oversold"),
        "macd_cross": F.when((before <= 0) & (F.col("macd_hist") > 0), "bullish").when((before >= 0) & (F.col("macd_hist") < 0), "bearish"),
    })
    return out.select("pair", "timestamp_utc", "rsi_alert", "macd_cross").where("rsi_alert is not null or macd_cross is not null")


def duration_rollup(durations: DataFrame) -> DataFrame:
    """(operation, n, total, mean, least, most, share_pct) of (operation, seconds) rows."""
    by = durations.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    whole = durations.agg(F.sum("seconds").alias("__all"))
    return by.crossJoin(F.broadcast(whole)).select("operation", "n", "total", "mean", "least", "most", (100 * F.col("total") / F.col("__all")).alias("share_pct"))


def resource_rollup(samples: DataFrame, columns: list[str], by: str = "operation") -> DataFrame:
    """(operation, resource, n, mean, least, most) of sampled loads, one column a resource; nulls are not counted."""
    long = samples.select(by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([by], columns, "resource", "used").where("used is not null")
    return long.groupBy(by, "resource").agg(F.count(F.lit(1)).alias("n"), F.avg("used").alias("mean"), F.min("used").alias("least"), F.max("used").alias("most"))


def append_log(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Add rows to a log of CSV or JSON lines; files that are there stay."""
    rows.write.mode("append").option("header", True).format(kind).save(path)


def performance(trades: DataFrame) -> DataFrame:
    """(pair, trades, net_return, win_rate, mean_hours, sharpe, max_drawdown) of closed trades by pair.

    trades: (pair, closed_at, return_pct, hours), returns as fractions, compounded in order of closing.
    sharpe is the mean over the sample deviation of returns; drawdown is the largest fall from a
    previous peak of the compounded capital, which starts at 1.
    """
    order = Window.partitionBy("pair").orderBy("closed_at").rowsBetween(Window.unboundedPreceding, 0)
    # A product over a window by logarithms; a loss of everything ends the capital.
    grown = trades.withColumn("__log", F.log(F.greatest(1 + F.col("return_pct"), F.lit(1e-12)))).withColumn("__capital", F.exp(F.sum("__log").over(order)))
    grown = grown.withColumn("__peak", F.greatest(F.lit(1.0), F.max("__capital").over(order)))
    sd = F.stddev_samp("return_pct")
    return grown.groupBy("pair").agg(
        F.count(F.lit(1)).alias("trades"), (F.exp(F.sum("__log")) - 1).alias("net_return"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"),
        F.avg("hours").alias("mean_hours"), F.when(sd > 0, F.avg("return_pct") / sd).alias("sharpe"), F.max(1 - F.col("__capital") / F.col("__peak")).alias("max_drawdown"),
    )
