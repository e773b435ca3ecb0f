"""Insert-ignore, join-update and partitioned writes of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.frames import rounded_short

#: Columns stored as small integers: ranks, calendar, sessions, patterns and targets. Fixed values.
SMALLINT = (
    "performance_rank_btc_1h", "performance_rank_eth_1h", "volume_rank_1h", "volatility_rank_1h",
    "was_profitable_12h", "profit_target_1pct", "profit_target_2pct",
    "hour_of_day", "day_of_week", "month_of_year", "is_weekend", "asian_session", "european_session", "american_session",
    "pattern_doji", "pattern_engulfing", "pattern_hammer", "pattern_morning_star",
)
KEY = ["pair", "timestamp_utc"]


def one_of_each(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: of several the greatest, compared column by column, so that reruns agree."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__row")).select(*(F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns))


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks, one for each key: what is to be appended."""
    key = key or KEY
    return one_of_each(new, key).join(existing.select(*key), key, "left_anti")


def fit_schema(df: DataFrame, columns: list[str], reserved: tuple = ("id",)) -> DataFrame:
    """``df`` with those of its columns that the target has; reserved ones go, small integers are rounded."""
    kept = [c for c in df.columns if c in columns and c not in reserved]
    return df.select(*(rounded_short(F.col(c)).alias(c) if c in SMALLINT else F.col(c) for c in kept))


def join_update(target: DataFrame, updates: DataFrame, key: list[str] | None = None, missing: float = 0.0) -> DataFrame:
    """``target`` with the values of ``updates`` where the key is there; columns and rows stay the target's.

    In a row that is updated, a null update is written as ``missing``. A row's key decides alone: updates without
    a target row are not inserted. The shuffle is on the key; with tables bucketed by it there is none.
    """
    key = key or KEY
    cols = [c for c in updates.columns if c in target.columns and c not in key]
    side = one_of_each(updates.select(*key, *cols), key).select(*key, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__new_{c}") for c in cols))
    joined = target.join(side, key, "left")
    kinds = dict(target.dtypes)
    fill = lambda c: F.coalesce(F.col(f"__new_{c}").cast(kinds[c]), F.lit(missing).cast(kinds[c])) if kinds[c] in ("double", "float", "smallint", "int", "bigint") else F.col(f"__new_{c}")
    return joined.select(*(F.when(F.col("__hit"), fill(c)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by month, replacing only the months that ``df`` has rows of."""
    month = F.date_format("timestamp_utc", "yyyy-MM")
    df.withColumn("month", month).repartition("month", "pair").sortWithinPartitions("pair", "timestamp_utc").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """A table bucketed and sorted by pair, so that later windows and joins on the pair need no shuffle; at ``path`` if given."""
    out = df.repartition(buckets, "pair").write.bucketBy(buckets, "pair").sortBy("pair", "timestamp_utc").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)


def analyze(spark: SparkSession, table: str, columns: tuple = ("pair", "timestamp_utc")) -> None:
    """Statistics of a table and its key columns, by which Spark orders joins and picks what to broadcast.

    Two tables bucketed alike by pair are joined on pair and time without an exchange where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false.
    """
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
