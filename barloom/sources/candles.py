"""Bars from events, and the scans of bars. Filters and columns reach the Parquet scan by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(time: Column, number: Column | None) -> Column:
    """What orders events: their time, then their number. One decimal, as aggregation buffers of fixed width hash, where a struct would sort."""
    t = F.unix_micros(time.cast("timestamp"))
    if number is None:
        return t
    return t.cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + number.cast("decimal(19,0)")


def candles_from_events(events: DataFrame, width: str = "1 hour", pair: str = "event_type") -> DataFrame:
    """Bars of ``width`` for each value of ``pair``: first, greatest, least and last value, count as volume.

    Partial aggregates meet in one shuffle; event times need no time zone. Events without pair, time or
    value make no bar. Of events of one time, the event_id decides which is first and last.
    """
    t = F.col("ts")
    at = moment(t, F.coalesce("event_id", F.lit(-1)) if "event_id" in events.columns else None)
    rows = events.where(F.col(pair).isNotNull() & t.isNotNull() & F.col("value").isNotNull())
    bars = rows.groupBy(F.col(pair).cast("string").alias("pair"), F.window(t, width).start.alias("timestamp_utc")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ``events`` table by event type."""
    return candles_from_events(read_table(spark, sf_dir, "events"))


def of_pair(bars: DataFrame, pair: str) -> DataFrame:
    return bars.where(F.col("pair") == pair)


def of_pairs(bars: DataFrame, listed: DataFrame, pair: str = "pair") -> DataFrame:
    """Bars of the pairs that ``listed`` has: a semi join, so that repeated entries do not repeat bars."""
    return bars.join(listed.select(F.col(pair).alias("pair")), "pair", "left_semi")


def in_range(bars: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Bars from ``start`` to ``end``, both included."""
    kind = dict(bars.dtypes)["timestamp_utc"]
    bound = lambda x: F.lit(x).cast(kind) if isinstance(x, str) else x
    return bars.where(F.col("timestamp_utc").between(bound(start), bound(end)))


def latest(bars: DataFrame, n: int) -> DataFrame:
    """Each pair's newest n bars; row numbers beyond n are cut before the shuffle where Spark can."""
    newest = Window.partitionBy("pair").orderBy(F.desc("timestamp_utc"))
    return bars.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")


def trailing(bars: DataFrame, days: int) -> DataFrame:
    """Bars within ``days`` of the newest bar of all pairs: one scalar, joined as a broadcast row."""
    newest = bars.agg((F.max("timestamp_utc") - F.expr(f"interval {days} days")).alias("__from"))
    return bars.join(F.broadcast(newest), F.col("timestamp_utc") >= F.col("__from")).drop("__from")


def rolling_days(rows: int) -> int:
    """Days that a rolling cross-section reads for ``rows`` hourly rows."""
    return max(30, rows // 24)


def pairs(bars: DataFrame) -> DataFrame:
    return bars.select("pair").distinct()


def known_bounds(bars: DataFrame) -> DataFrame:
    """(pair, first_time, last_time, rows): what a fetcher already has."""
    return bars.groupBy("pair").agg(F.min("timestamp_utc").alias("first_time"), F.max("timestamp_utc").alias("last_time"), F.count(F.lit(1)).alias("rows"))


def chart_window(bars: DataFrame, pair: str | None, columns: list[str], start: str | None = None, end: str | None = None, limit: int = 1000) -> DataFrame:
    """Columns of one pair's newest ``limit`` bars between two bounds, each of which may be open."""
    kind = dict(bars.dtypes)["timestamp_utc"]
    if pair is not None:
        bars = bars.where(F.col("pair") == pair)
    if start is not None:
        bars = bars.where(F.col("timestamp_utc") >= F.lit(start).cast(kind))
    if end is not None:
        bars = bars.where(F.col("timestamp_utc") <= F.lit(end).cast(kind))
    return bars.select("pair", "timestamp_utc", *columns).orderBy(F.desc("timestamp_utc"), "pair").limit(limit)
