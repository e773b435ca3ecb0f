"""Exchange messages: positional arrays of texts, funding rates, trades and premiums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import millis, truthy

QUOTE_SUFFIX, SWAP = "-USDT-SWAP", "-SWAP"


def _number(a: str, i: int) -> Column:
    return F.expr(f"try_cast({a}[{i}] as double)")


def parse_candles(messages: DataFrame, data: str = "data", symbol: str = "symbol") -> DataFrame:
    """Bars from JSON arrays ``[ts, o, h, l, c, vol, volCcy, volCcyQuote, confirm]`` of texts.

    Messages with fewer than nine elements, or without a time, are skipped; other bad numbers are null.
    """
    rows = messages.select(F.col(symbol).alias("symbol"), F.from_json(data, "array<string>").alias("a")).where(F.size("a") >= 9)
    rows = rows.withColumn("ms", F.expr("try_cast(a[0] as bigint)")).where("ms is not null")
    names = ("open", "high", "low", "close", "volume", "volume_ccy", "volume_quote")
    return rows.select(millis(F.col("ms")).alias("timestamp"), "symbol", *(_number("a", i + 1).alias(n) for i, n in enumerate(names)), truthy(F.col("a")[8]).alias("confirmed"))


def parse_price_candles(messages: DataFrame, data: str = "data", symbol: str = "symbol", index: bool = False) -> DataFrame:
    """Mark or index bars from ``[ts, o, h, l, c, confirm]``; index symbols lose their swap suffix."""
    rows = messages.select(F.col(symbol).alias("symbol"), F.from_json(data, "array<string>").alias("a")).where(F.size("a") >= 6)
    rows = rows.withColumn("ms", F.expr("try_cast(a[0] as bigint)")).where("ms is not null")
    name = F.regexp_replace("symbol", f"{SWAP}$", "") if index else F.col("symbol")
    return rows.select(millis(F.col("ms")).alias("timestamp"), name.alias("symbol"), *(_number("a", i + 1).alias(n) for i, n in enumerate(("open", "high", "low", "close"))), truthy(F.col("a")[5]).alias("confirmed"))


def _fields(messages: DataFrame, data: str, kept: list[Column], *names: str) -> DataFrame:
    """``kept`` columns and the named fields of JSON objects as texts. A generator reads each message once; filters on its fields stay above it."""
    return messages.select(*kept, F.json_tuple(data, *names).alias(*names))


def _as(name: str, kind: str) -> Column:
    return F.expr(f"try_cast(`{name}` as {kind})")


def parse_funding(messages: DataFrame, data: str = "data") -> DataFrame:
    """Funding rows from JSON objects; an absent or empty realized rate is 0."""
    rate = lambda k: F.expr(f"try_cast(nullif({k}, '') as double)")
    return _fields(messages, data, [], "fundingTime", "instId", "fundingRate", "realizedRate", "formulaType", "method").select(
        millis(_as("fundingTime", "bigint")).alias("funding_time"), F.col("instId").alias("symbol"),
        rate("fundingRate").alias("funding_rate"), F.coalesce(rate("realizedRate"), F.lit(0.0)).alias("realized_rate"),
        F.col("formulaType").alias("formula_type"), "method",
    )


def parse_trades(messages: DataFrame, data: str = "data", pair: str = "pair") -> DataFrame:
    """Trades from JSON objects; those without a number for price, size or time are skipped."""
    rows = _fields(messages, data, [F.col(pair).alias("pair")], "tradeId", "px", "sz", "side", "ts")
    rows = rows.select("pair", F.col("tradeId").alias("trade_id"), _as("px", "double").alias("price"), _as("sz", "double").alias("quantity"), "side", millis(_as("ts", "bigint")).alias("timestamp_utc"))
    return rows.where("trade_id is not null and price is not null and quantity is not null and timestamp_utc is not null")


def parse_premiums(messages: DataFrame, data: str = "data", symbol: str = "symbol") -> DataFrame:
    """Premium rows from JSON objects with ts and premium."""
    rows = _fields(messages, data, [F.col(symbol).alias("symbol")], "ts", "premium")
    return rows.select(millis(_as("ts", "bigint")).alias("timestamp"), "symbol", _as("premium", "double").alias("premium")).where("timestamp is not null and premium is not null")


def swap_pairs(instruments: DataFrame) -> DataFrame:
    """Live instruments quoted in the base currency: (symbol)."""
    ok = F.col("instId").endswith(QUOTE_SUFFIX) | ((F.col("quoteCcy") == "USDT") & (F.col("state") == "live"))
    return instruments.where(ok).select(F.col("instId").alias("symbol")).distinct()


def fetch_summary(logs: DataFrame, line: str = "line") -> DataFrame:
    """(inserted, errors, first_time) from log lines of a fetch run."""
    n = F.regexp_extract(line, r"(?i)inserted (\d+)", 1)
    seen = F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    return logs.agg(
        F.coalesce(F.sum(F.when(n != "", n.cast("bigint"))), F.lit(0)).alias("inserted"),
        F.count_if(F.col(line).rlike(r"(?i)\berror\b")).alias("errors"),
        F.min(F.when(seen != "", seen)).alias("first_time"),
    )

