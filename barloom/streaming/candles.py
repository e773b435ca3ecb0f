"""Bars from an event stream, written by idempotent micro-batches, and recursive means kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.schemas import EVENTS
from barloom.sources.candles import moment


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events from Parquet files below ``path`` as they land."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def candle_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream; events later than ``late`` behind the newest are dropped, and their state with them.

    Repeated events (same id within the watermark) count once.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    at = moment(F.col("ts"), F.col("event_id"))
    bars = rows.groupBy(F.col("event_type").alias("pair"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.select("pair", F.col("w.start").alias("timestamp_utc"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps each batch's changed bars below ``path``; run with whatever has landed.

    A batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return bars.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_bars(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each bar that ``write_bars`` has kept."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("pair", "timestamp_utc", "batch")]
    newest = rows.groupBy("pair", "timestamp_utc").agg(F.max_by(F.struct(*cols), "batch").alias("b"))
    return newest.select("pair", "timestamp_utc", "b.*")


def ewm_stream(bars: DataFrame, span: int = 12, column: str = "close", late: str = "1 day") -> DataFrame:
    """(pair, timestamp_utc, ewm): an exponential mean over arriving bars, a few numbers of state a pair.

    Bars must arrive in order of time within a pair; those not newer than the last one seen are skipped.
    """
    a = 2.0 / (span + 1.0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mean = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("timestamp_utc")
        out = []
        for t, x in zip(rows["timestamp_utc"], rows[column], strict=True):
            at = int(t.value)
            if last is not None and at <= last:
                continue
            mean = x if mean is None else a * x + (1 - a) * mean
            last = at
            out.append((key[0], t, mean))
        if last is not None:
            state.update((last, mean))
        yield pd.DataFrame(out, columns=["pair", "timestamp_utc", "ewm"])

    return bars.groupBy("pair").applyInPandasWithState(step, "pair string, timestamp_utc timestamp, ewm double", "last long, mean double", "append", GroupStateTimeout.NoTimeout)


def affected_tail(bars: DataFrame, changed: DataFrame, horizon: int = 336) -> DataFrame:
    """Bars whose features or labels ``changed`` bars may alter: from ``horizon`` rows before each pair's first change."""
    first = changed.groupBy("pair").agg(F.min("timestamp_utc").alias("__first"))
    rows = bars.join(first, "pair")
    back = Window.partitionBy("pair").orderBy(F.desc("timestamp_utc"))
    older = F.row_number().over(back) - F.count_if(F.col("timestamp_utc") >= F.col("__first")).over(Window.partitionBy("pair"))
    return rows.withColumn("__k", older).where(F.col("__k") <= horizon).drop("__k", "__first")
