"""Gap detection, the missing hours, and their count by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import lag


def gaps(bars: DataFrame, minutes: int = 66) -> DataFrame:
    """(pair, gap_start, gap_end, missing) where neighbouring bars are more than ``minutes`` apart."""
    t = F.col("timestamp_utc").cast("timestamp")
    seen = bars.select("pair", "timestamp_utc", lag("timestamp_utc").alias("gap_start"))
    seconds = F.unix_seconds(t) - F.unix_seconds(F.col("gap_start").cast("timestamp"))
    return seen.where(seconds > minutes * 60).select("pair", "gap_start", F.col("timestamp_utc").alias("gap_end"), (F.floor(seconds / 3600) - 1).cast("bigint").alias("missing"))


def missing_hours(bars: DataFrame) -> DataFrame:
    """(pair, timestamp_utc) of each absent hour between a pair's first and last bar."""
    hour = F.expr("interval 1 hour")
    found = gaps(bars).where("missing > 0")
    return found.select("pair", F.explode(F.sequence(F.col("gap_start") + hour, F.col("gap_end") - hour, hour)).alias("timestamp_utc"))


def missing_by_day(bars: DataFrame) -> DataFrame:
    """(day, missing_hours, pairs) over all pairs."""
    return missing_hours(bars).groupBy(F.to_date("timestamp_utc").alias("day")).agg(F.count(F.lit(1)).alias("missing_hours"), F.countDistinct("pair").alias("pairs"))


def fill_gaps(bars: DataFrame, fetched: DataFrame, seconds: int = 300) -> DataFrame:
    """``bars`` and those of ``fetched`` that stand within ``seconds`` of a missing hour, moved onto it.

    Of several for one hour the nearest counts, then the earliest.
    """
    from .joins import within

    cols = [c for c in bars.columns if c not in ("pair", "timestamp_utc")]
    wanted = missing_hours(bars).withColumnRenamed("timestamp_utc", "__hour")
    near = within(wanted, fetched.withColumnRenamed("timestamp_utc", "__seen"), "pair", "__hour", "__seen", seconds)
    off = F.abs(F.unix_micros(F.col("__hour").cast("timestamp")) - F.unix_micros(F.col("__seen").cast("timestamp")))
    best = near.groupBy("pair", F.col("__hour").alias("timestamp_utc")).agg(F.min(F.struct(off.alias("off"), F.col("__seen").alias("seen"), *cols)).alias("b"))
    return bars.unionByName(best.select("pair", "timestamp_utc", *(F.col(f"b.{c}").alias(c) for c in cols)))
