"""Registered queries over the given tables. Doubles are rounded on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.frames import clean, numbered
from barloom.functions.scratch import new_path
from barloom.operators import features, gaps, joins, upsert
from barloom.operators.cross_pair import cross_pair
from barloom.operators.halo import features_by_slot
from barloom.operators.keyfilter import build_filter, insert_unknown
from barloom.operators.multi_timeframe import complete_grid, multi_timeframe, resample
from barloom.operators.recursive import MOMENTUM, STATISTICAL, VOLATILITY, VOLUME, recursive
from barloom.operators.slots import numbered_by_slot, recursive_by_slot
from barloom.params import CrossPair, Params
from barloom.plans import reports
from barloom.plans.pipeline import compute_features, rolling_update, tidy
from barloom.quality import validators
from barloom.sources import candles, raw
from barloom.sources.stored import StoredTable

#: The roles of benchmark pairs in the test tables.
PARAMS = Params(cross_pair=CrossPair(btc="click", eth="view"))
RAW = ["open", "high", "low", "close", "volume"]


def _added(make, *only: str):
    """A query for the columns that a feature group adds to hourly bars."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(numbered(candles.hourly(spark, sf_dir)))
        cols = list(only) or [c for c in df.columns if c not in ("pair", "timestamp_utc", *RAW, "__i", "__n")]
        return tidy(df.select("pair", "timestamp_utc", *cols))

    return query


def q_candles(spark, sf_dir):
    return tidy(candles.hourly(spark, sf_dir))


def q_candles_by_user(spark, sf_dir):
    return tidy(candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 day", "user_id"))


def q_scan_pair(spark, sf_dir):
    return tidy(candles.in_range(candles.of_pair(candles.hourly(spark, sf_dir), "click"), "2024-01-05", "2024-01-12"))


def q_scan_latest(spark, sf_dir):
    return tidy(candles.latest(candles.hourly(spark, sf_dir), 100))


def q_scan_trailing(spark, sf_dir):
    return tidy(candles.trailing(candles.hourly(spark, sf_dir), 7))


def q_pairs(spark, sf_dir):
    return candles.pairs(candles.hourly(spark, sf_dir))


def q_known_bounds(spark, sf_dir):
    return candles.known_bounds(candles.hourly(spark, sf_dir))


def q_parse_candles(spark, sf_dir):
    """Bars written as exchange messages and parsed back; every fifth message is malformed."""
    bars = numbered(candles.hourly(spark, sf_dir))
    ms = F.unix_millis(F.to_utc_timestamp(F.col("timestamp_utc").cast("timestamp"), F.lit("UTC")))
    texts = [ms.cast("string"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")), F.lit(""), F.lit("x"), F.lit("1")]
    message = F.when(F.col("__i") % 5 == 4, F.to_json(F.array(*texts[:6]))).otherwise(F.to_json(F.array(*texts)))
    parsed = raw.parse_candles(bars.select(F.concat("pair", F.lit("-SWAP")).alias("symbol"), message.alias("data")))
    return tidy(parsed.select("symbol", F.unix_millis("timestamp").alias("ms"), "open", "high", "low", "close", "volume", "volume_ccy", "volume_quote", "confirmed"))


def q_parse_funding(spark, sf_dir):
    """Events as funding messages; the realized rate is absent where the event's number is even."""
    e = candles.read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rate = F.when(k % 2 == 0, F.lit("")).otherwise((F.col("value") / 1000).cast("string"))
    data = F.to_json(F.struct((F.col("event_id") * 1000).cast("string").alias("fundingTime"), F.concat("event_type", F.lit("-USDT-SWAP")).alias("instId"), F.col("value").cast("string").alias("fundingRate"), rate.alias("realizedRate"), F.lit("noRate").alias("formulaType")))
    out = raw.parse_funding(e.select(data.alias("data")))
    return tidy(out.select(F.unix_millis("funding_time").alias("ms"), "symbol", "funding_rate", "realized_rate", "formula_type"))


def q_resample_4h(spark, sf_dir):
    return tidy(resample(candles.hourly(spark, sf_dir), "4 hours"))


def q_resample_grid(spark, sf_dir):
    bars = resample(candles.hourly(spark, sf_dir), "4 hours")
    return tidy(complete_grid(bars, "4 hours").drop("rows"))


def q_multi_timeframe(spark, sf_dir):
    df = multi_timeframe(candles.hourly(spark, sf_dir))
    return tidy(df.drop(*RAW))


def q_multi_timeframe_grid(spark, sf_dir):
    """Higher frames over all their bars, empty ones included; every third stretch of nine hours is taken out first."""
    bars = candles.hourly(spark, sf_dir).where("(unix_seconds(cast(timestamp_utc as timestamp)) div 32400) % 3 <> 1")
    return tidy(multi_timeframe(bars, complete=True).drop(*RAW))


def q_multi_timeframe_closed(spark, sf_dir):
    df = multi_timeframe(candles.hourly(spark, sf_dir), closed_bars_only=True)
    return tidy(df.select("pair", "timestamp_utc", "close_4h", "volume_4h", "close_1d", "volume_1d"))


def q_cross_pair(spark, sf_dir):
    df = compute_features(candles.hourly(spark, sf_dir), PARAMS, ["price_action", "labels", "recursive"])
    made = cross_pair(df, PARAMS)
    return tidy(made.select("pair", "timestamp_utc", "volume_rank_1h", "volatility_rank_1h", "performance_rank_btc_1h", "performance_rank_eth_1h", "btc_corr_24h", "prev_volume_rank"))


def q_cross_section_wide(spark, sf_dir):
    """Volume ranks over daily bars of all users."""
    from barloom.operators.cross_pair import percent_rank_of

    df = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 day", "user_id")
    return df.select("pair", "timestamp_utc", percent_rank_of("volume").alias("volume_rank"), percent_rank_of("high").alias("high_rank"))


def _premiums(spark, sf_dir):
    e = candles.read_table(spark, sf_dir, "events")
    return e.where("event_type in ('purchase', 'error')").select(F.when(F.col("event_type") == "purchase", "click").otherwise("view").alias("pair"), F.col("ts").alias("premium_time"), F.col("value").alias("premium"))


def q_asof_premium(spark, sf_dir):
    out = joins.asof_backward(candles.hourly(spark, sf_dir), _premiums(spark, sf_dir), "pair", "timestamp_utc", "premium_time", ["premium"])
    return tidy(out.select("pair", "timestamp_utc", "close", "premium"))


def q_range_match(spark, sf_dir):
    """Bars and purchases of their pair within five minutes of the bar's start."""
    out = joins.within(candles.hourly(spark, sf_dir), _premiums(spark, sf_dir), "pair", "timestamp_utc", "premium_time", 300)
    return tidy(out.select("pair", "timestamp_utc", "premium_time", "premium"))


def q_gaps(spark, sf_dir):
    return gaps.gaps(candles.hourly(spark, sf_dir))


def q_missing_hours(spark, sf_dir):
    return gaps.missing_hours(candles.hourly(spark, sf_dir))


def q_missing_by_day(spark, sf_dir):
    return gaps.missing_by_day(candles.hourly(spark, sf_dir))


def q_fill_gaps(spark, sf_dir):
    """Missing hours filled from single events near them."""
    bars = candles.hourly(spark, sf_dir)
    e = candles.read_table(spark, sf_dir, "events").where("event_type <> 'click'")
    got = e.select(F.lit("click").alias("pair"), F.col("ts").alias("timestamp_utc"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))
    return tidy(gaps.fill_gaps(candles.of_pair(bars, "click"), got))


def q_insert_ignore(spark, sf_dir):
    """What a second fetch of all bars adds to the bars before the last week."""
    bars = candles.hourly(spark, sf_dir)
    have = candles.in_range(bars, "2024-01-01", "2024-01-22 23:00:00")
    return tidy(upsert.insert_ignore(have, bars.unionByName(bars)))


def q_join_update(spark, sf_dir):
    """Bars whose volume is replaced in one day; a missing update is 0."""
    bars = candles.hourly(spark, sf_dir)
    day = candles.in_range(bars, "2024-01-10", "2024-01-10 23:00:00")
    new = day.select("pair", "timestamp_utc", F.when(F.hour("timestamp_utc") % 2 == 0, F.col("volume") * 10).alias("volume"))
    return tidy(upsert.join_update(bars, new))


def q_completeness(spark, sf_dir):
    df = features.labels(numbered(candles.hourly(spark, sf_dir))).drop("__i", "__n")
    df = df.withColumn("quote_volume", F.when(F.hour("timestamp_utc") % 3 == 0, F.col("volume")))
    return validators.count_issues(*validators.completeness_checks(df))


def q_raw_ohlcv(spark, sf_dir):
    """Order checks over line items read as bars: price, tax and discount stand for the bar's prices."""
    li = candles.read_table(spark, sf_dir, "lineitem")
    bars = li.select(F.col("l_returnflag").alias("pair"), F.col("l_extendedprice").alias("open"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("high"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("low"), (F.col("l_quantity") * 1000).alias("close"), (F.col("l_quantity") - 2).alias("volume"), F.col("l_quantity").alias("taker_buy_base"))
    return validators.count_issues(bars, validators.raw_checks(bars.columns))


def q_sanity(spark, sf_dir):
    df = compute_features(candles.hourly(spark, sf_dir), PARAMS, ["price_action", "labels", "pattern"]).select("pair", "timestamp_utc", *RAW, "log_return", "gap_open", "prev_close_change_pct", "future_return_1h_pct", "future_max_return_24h_pct", "pattern_doji")
    return validators.count_issues(*validators.sanity_checks(df.withColumn("rsi_1h", F.col("close"))))


def q_recompute(spark, sf_dir):
    """Stored features with a disturbance in every seventh bar, against their recomputation."""
    bars = numbered(candles.hourly(spark, sf_dir))
    stored = features.price_action(bars)
    off = F.when(F.col("__i") % 7 == 3, 1e-3).otherwise(0.0)
    return validators.recomputed(stored.withColumns({"upper_shadow": F.col("upper_shadow") + off, "gap_open": F.col("gap_open") + off}).drop("__i", "__n"), {"price_action": ["price_action"]})


def q_validate_clean(spark, sf_dir):
    """Recomputing validators over freshly computed features: no pair has an issue."""
    bars = candles.hourly(spark, sf_dir)
    stored = compute_features(bars, PARAMS, ["price_action", "momentum", "volatility", "volume", "statistical", "pattern", "calendar", "labels", "recursive"])
    found = validators.validate(stored, PARAMS, skip=("raw_ohlcv", "completeness", "sanity")).groupBy("pair").agg(F.sum("issues").alias("issues"))
    return bars.groupBy("pair").agg(F.count(F.lit(1)).alias("candles")).join(found, "pair", "left").select("pair", "candles", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))


def q_distributions(spark, sf_dir):
    return tidy(validators.distributions(candles.hourly(spark, sf_dir), ["open", "close", "volume"]))


def q_distribution_issues(spark, sf_dir):
    li = candles.read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "pair").withColumns(
        {"cube": F.pow(F.col("l_quantity") / 10, F.lit(6)), "rest": F.when(F.col("l_tax") < 0.05, 0.0).otherwise(F.col("l_tax")), "rare": F.when(F.col("l_quantity") == 50, F.col("l_extendedprice")).otherwise(F.col("l_tax"))}
    )
    return tidy(validators.distribution_issues(validators.distributions(li, ["l_quantity", "l_extendedprice", "cube", "rest", "rare"])))


def q_issue_grades(spark, sf_dir):
    return validators.grade(q_completeness(spark, sf_dir), candles.hourly(spark, sf_dir))


def q_top_offenders(spark, sf_dir):
    return validators.top_offenders(q_completeness(spark, sf_dir))


def q_commonest_issues(spark, sf_dir):
    return validators.commonest(q_completeness(spark, sf_dir))


def q_issue_neighbourhood(spark, sf_dir):
    bars = candles.hourly(spark, sf_dir)
    issues = gaps.gaps(bars).select("pair", F.col("gap_end").alias("issue_time"))
    return tidy(joins.issue_neighbourhood(issues, bars).select("pair", "issue_time", "timestamp_utc", "close"))


def q_market_summary(spark, sf_dir):
    return tidy(reports.market_summary(candles.hourly(spark, sf_dir)))


def q_movers(spark, sf_dir):
    bars = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 hour", "user_id")
    return tidy(reports.movers(reports.market_summary(bars)))


def q_alerts(spark, sf_dir):
    """RSI and crossover alerts; the histogram is the difference of two price changes, rounded."""
    df = recursive(candles.hourly(spark, sf_dir), PARAMS, ("rsi_1h", "macd_hist_slope_1h")).withColumn("macd_hist", F.round("macd_hist_slope_1h", 6))
    return reports.alerts(df.withColumn("rsi_1h", F.round("rsi_1h", 6)))


def q_duration_rollup(spark, sf_dir):
    e = candles.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    return tidy(reports.duration_rollup(e))


def q_fetch_summary(spark, sf_dir):
    e = candles.read_table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR in user "), F.col("user_id"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" inserted "), F.get_json_object("props", "$.k"), F.lit(" candles")))
    return raw.fetch_summary(e.select(line.alias("line")))


def q_session_time(spark, sf_dir):
    """Bars by local hour of a display time zone."""
    b = candles.hourly(spark, sf_dir)
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Amsterdam"), F.col("timestamp_utc"))
    return b.groupBy(F.hour(local).alias("local_hour")).agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


def q_rolling_update(spark, sf_dir):
    """A rolling update of window features: equal to the newest rows of a full run."""
    params = Params(rolling=200, look_back=300, cross_pair=PARAMS.cross_pair)
    made = rolling_update(candles.hourly(spark, sf_dir), params, ["price_action", "volatility"])
    return tidy(made.select("pair", "timestamp_utc", "log_return", "price_acceleration", "true_range", "bollinger_width_1h", "historical_vol_30"))


def q_streaming_candles(spark, sf_dir):
    """The events as a stream: watermark, tumbling windows, idempotent batches; then the current bars."""
    from barloom.streaming.candles import candle_stream, current_bars, event_stream, write_bars

    root = new_path(spark, "stream")
    bars = candle_stream(event_stream(spark, f"{sf_dir}/events.parq*"), late="60 days")
    write_bars(bars, f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    out = current_bars(spark, f"{root}/bars")
    return tidy(out.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz")))


def q_parse_trades(spark, sf_dir):
    """Line items as trade messages; a discount of 0 stands for a missing size, which is skipped."""
    li = candles.read_table(spark, sf_dir, "lineitem")
    size = F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("string")).otherwise("")
    data = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("tradeId"), F.col("l_extendedprice").cast("string").alias("px"), size.alias("sz"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_partkey") * 1000).cast("string").alias("ts")))
    out = raw.parse_trades(li.select(F.col("l_linestatus").alias("pair"), data.alias("data")))
    return tidy(out.select("pair", "trade_id", "price", "quantity", "side", F.unix_millis("timestamp_utc").alias("ms")))


def q_new_trades(spark, sf_dir):
    """Order ids that are not yet known: a left-anti join, one row for each id."""
    orders = candles.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_orderstatus").alias("side"))
    known = candles.read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trade_id")).where("trade_id % 3 <> 0").distinct()
    return upsert.insert_ignore(known, orders, ["trade_id"])


def q_premium_history(spark, sf_dir):
    """Premium messages parsed, then aligned to the bars' times."""
    sent = _premiums(spark, sf_dir).select("pair", F.to_json(F.struct(F.unix_millis(F.col("premium_time").cast("timestamp")).cast("string").alias("ts"), F.col("premium").cast("string").alias("premium"))).alias("data"))
    got = raw.parse_premiums(sent, symbol="pair").withColumn("at", F.col("timestamp").cast("timestamp_ntz")).groupBy("symbol", "at").agg(F.max("premium").alias("premium")).withColumnRenamed("symbol", "pair")
    out = joins.asof_backward(candles.hourly(spark, sf_dir).select("pair", "timestamp_utc"), got, "pair", "timestamp_utc", "at", ["premium"])
    return tidy(out.select("timestamp_utc", F.col("pair").alias("symbol"), "premium"))


def q_chart_window(spark, sf_dir):
    return tidy(candles.chart_window(candles.hourly(spark, sf_dir), "view", ["open", "high", "low", "close", "volume"], end="2024-01-20", limit=200))


def q_report_reader(spark, sf_dir):
    """A written JSON report, read back: label leakage and gaps go, missing values stay, with hints."""
    path = new_path(spark, "report")
    validators.write_report(q_completeness(spark, sf_dir), path)
    return validators.drill_down(validators.read_report(spark, path, "completeness", "null_values")).select("pair", "column", "issues", "candles", "hint")


def q_performance(spark, sf_dir):
    """Trades that buy at each bar's open and sell at its close."""
    b = candles.hourly(spark, sf_dir).where("open > 0")
    trades = b.select("pair", F.col("timestamp_utc").alias("closed_at"), F.least((F.col("close") / F.col("open") - 1) / 10, F.lit(0.5)).alias("return_pct"), F.lit(1.0).alias("hours"))
    out = reports.performance(trades)
    return out.select("pair", "trades", *(F.round(c, 6).alias(c) for c in ("win_rate", "mean_hours", "sharpe", "max_drawdown")), F.round(F.log(1 + F.col("net_return")), 6).alias("log_growth"))


def q_full_backfill(spark, sf_dir):
    """All feature groups of all bars in one plan."""
    return tidy(compute_features(candles.hourly(spark, sf_dir), PARAMS).drop(*RAW))


def q_top_width(spark, sf_dir):
    """The ten widest Bollinger bands of each pair."""
    df = features.volatility(numbered(candles.hourly(spark, sf_dir)))
    df = features.price_action(df).select("pair", "timestamp_utc", "log_return", "true_range", F.round("bollinger_width_1h", 6).alias("bollinger_width_1h"))
    order = Window.partitionBy("pair").orderBy(F.desc("bollinger_width_1h"), "timestamp_utc")
    return tidy(df.withColumn("place", F.row_number().over(order)).where("place <= 10"))


def q_scan_listed(spark, sf_dir):
    """Bars of the live instruments of a list with repeats: a semi join."""
    e = candles.read_table(spark, sf_dir, "events")
    listed = e.select(F.concat("event_type", F.when(F.col("event_type") == "view", "-USDT").otherwise("-USDT-SWAP")).alias("instId"), F.lit("USDT").alias("quoteCcy"), F.when(F.col("event_type") == "view", "live").otherwise("off").alias("state")).where("event_type <> 'error'")
    pairs = raw.swap_pairs(listed).select(F.regexp_replace("symbol", "-USDT(-SWAP)?$", "").alias("pair"))
    return tidy(candles.of_pairs(candles.hourly(spark, sf_dir), pairs.unionAll(pairs)))


def q_parse_index_candles(spark, sf_dir):
    """Bars written as index messages of six texts and parsed back; every fourth is not confirmed."""
    bars = numbered(candles.hourly(spark, sf_dir))
    ms = F.unix_millis(F.col("timestamp_utc").cast("timestamp"))
    texts = [ms.cast("string"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close")), F.when(F.col("__i") % 4 == 0, "0").otherwise("1")]
    parsed = raw.parse_price_candles(bars.select(F.concat("pair", F.lit("-USDT-SWAP")).alias("symbol"), F.to_json(F.array(*texts)).alias("data")), index=True)
    return tidy(parsed.select("symbol", F.unix_millis("timestamp").alias("ms"), "open", "high", "low", "close", "confirmed"))


def _planted(validator: str):
    """A query for a recomputing validator: features of bars whose close is moved in some hours, held against the bars as they are.

    Some differences are below a column's tolerance and some above. Calendar columns, which no price changes, are moved themselves.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups, bars = validators.RECOMPUTE[validator], candles.hourly(spark, sf_dir)
        if validator == "temporal":
            stored = numbered(compute_features(bars, PARAMS, groups))
            off = {c: (F.col(c) + F.when(F.col("__i") % 7 == 3, 2).otherwise(0)).cast(k) for c, k in stored.dtypes if c not in ("pair", "timestamp_utc", *RAW, "__i", "__n")}
            stored = stored.withColumns(off).drop("__i", "__n")
        else:
            part = F.hour("timestamp_utc") % 7
            moved = bars.withColumn("close", F.col("close") * F.when(part == 3, 1.0000000001).when(part == 5, 1.01).when(part == 1, 1.5).otherwise(1.0))
            stored = compute_features(moved, PARAMS, groups).drop("close").join(bars.select("pair", "timestamp_utc", "close"), ["pair", "timestamp_utc"])
        return validators.recomputed(stored, {validator: groups}, PARAMS)

    return query


def q_validate_cross_pair(spark, sf_dir):
    """Cross-section features with ranks above 100 and correlations below -1 set in some bars."""
    df = numbered(compute_features(candles.hourly(spark, sf_dir), PARAMS, ["cross_pair"]))
    ranks = {c: F.when(F.col("__i") % 11 == 2, 200).otherwise(F.col(c)) for c in ("volume_rank_1h", "volatility_rank_1h", "performance_rank_btc_1h", "performance_rank_eth_1h")}
    corr = F.when(F.col("__i") % 13 == 5, -3.0).otherwise(F.col("btc_corr_24h"))
    return validators.count_issues(df.withColumns({**ranks, "btc_corr_24h": corr}), validators.cross_pair_checks("click"))


def q_validate_targets(spark, sf_dir):
    """Labels whose targets and profit flags are turned over in some bars."""
    df = numbered(compute_features(candles.hourly(spark, sf_dir), PARAMS, ["labels"]))
    flip = lambda c, k: (F.when(F.col("__i") % k == 1, 1 - F.col(c)).otherwise(F.col(c))).cast("int")
    df = df.withColumns({"profit_target_1pct": flip("profit_target_1pct", 5), "profit_target_2pct": flip("profit_target_2pct", 9), "was_profitable_12h": flip("was_profitable_12h", 4)})
    return validators.count_issues(df, validators.target_checks())


def q_full_backfill_wide(spark, sf_dir):
    """All feature groups over hourly bars of every user: as many pairs as there are users.

    One column is left out: its divisor is next to 0 in sparse bars, and its quotient beyond 16 digits.
    """
    bars = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 hour", "user_id")
    return tidy(compute_features(bars, Params(cross_pair=CrossPair(btc="1", eth="2"))).drop(*RAW, "future_risk_adj_return_12h"))


def q_clean_values(spark, sf_dir):
    """Line items' ratios with NaN, infinities and nulls set to 0, in the columns that a target table has."""
    li = candles.read_table(spark, sf_dir, "lineitem")
    ratio = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).when(F.col("l_linenumber") > 3, F.col("l_tax") / F.col("l_quantity"))
    df = li.select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("timestamp_utc"), clean(ratio).alias("ratio"), (F.col("l_quantity") / 2).alias("volume_rank_1h"), F.lit(1).alias("unknown"))
    return tidy(upsert.fit_schema(df, ["pair", "timestamp_utc", "ratio", "volume_rank_1h", "id"]))


def q_resource_rollup(spark, sf_dir):
    """Line items as load samples: quantity, discount and tax stand for three resources; a discount of 0 is no sample."""
    li = candles.read_table(spark, sf_dir, "lineitem")
    loads = li.select(F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("cpu"), F.when(F.col("l_discount") > 0, 100 * F.col("l_discount")).alias("memory"), (100 * F.col("l_tax")).alias("gpu"))
    return tidy(reports.resource_rollup(loads, ["cpu", "memory", "gpu"]))


def q_duration_log(spark, sf_dir):
    """Durations logged in two runs that append to one log, read back and summed up."""
    e = candles.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds"))
    path = new_path(spark, "durations")
    for run in ("operation = 'click'", "operation <> 'click'"):
        reports.append_log(e.where(run), path)
    return tidy(reports.duration_rollup(spark.read.schema("operation string, seconds double").csv(path, header=True)))


def q_text_report(spark, sf_dir):
    return validators.text_report(q_completeness(spark, sf_dir), candles.hourly(spark, sf_dir))


def q_recheck(spark, sf_dir):
    """Around each disturbed bar, what is stored and what a recomputation gives."""
    stored = features.price_action(numbered(candles.hourly(spark, sf_dir)))
    stored = stored.withColumn("upper_shadow", F.col("upper_shadow") + F.when(F.col("__i") % 29 == 3, 1).otherwise(0))
    issues = stored.where("__i % 29 = 3").select("pair", F.col("timestamp_utc").alias("issue_time"), F.lit("upper_shadow").alias("column"))
    return tidy(validators.recheck(stored.drop("__i", "__n"), issues, PARAMS))


def q_write_partitioned(spark, sf_dir):
    """Bars written by month twice: the second write replaces the months that it has."""
    path = new_path(spark, "by-month")
    bars = candles.hourly(spark, sf_dir)
    upsert.write_partitioned(bars, path)
    upsert.write_partitioned(bars.withColumn("volume", F.col("volume") * 2), path)
    return tidy(spark.read.parquet(path).drop("month"))


def q_write_bucketed(spark, sf_dir):
    """The newest bars of each pair from a bucketed table: a window without a shuffle."""
    import uuid

    table = f"bars_{uuid.uuid4().hex}"
    upsert.write_bucketed(candles.hourly(spark, sf_dir), table, 8, new_path(spark, "bucketed"))
    return tidy(candles.latest(spark.table(table), 100))


def _one_pair(spark, sf_dir):
    """All events as bars of one second of one pair: the history that no task should hold."""
    e = candles.read_table(spark, sf_dir, "events").withColumn("every", F.lit("all"))
    return candles.candles_from_events(e, "1 second", "every")


def q_recursive_by_slot(spark, sf_dir):
    """Recursive means and running sums of one long pair, cut into days.

    One column is left out: its divisor is next to 0 where bars of one event have no span, and its quotient beyond 16 digits.
    """
    df = recursive_by_slot(_one_pair(spark, sf_dir), PARAMS, "1 day")
    return tidy(df.drop(*RAW, "chaikin_volatility"))


def q_features_by_slot(spark, sf_dir):
    """The window groups of one long pair, by blocks of 500 rows and their halos."""
    return tidy(features_by_slot(_one_pair(spark, sf_dir), PARAMS, width="1 day", block_rows=500).drop(*RAW))


def q_rows_by_slot(spark, sf_dir):
    """Row numbers and counts of every user's events, numbered a day at a time."""
    bars = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 second", "user_id")
    return numbered_by_slot(bars, "1 day").select("pair", "timestamp_utc", F.col("__i").alias("i"), F.col("__n").alias("n"))


def _streamed(spark, chunks, make, root):
    """What ``make`` gives of a stream that ends and goes on from its checkpoint after each of ``chunks``; every batch in its own folder."""
    from barloom.streaming import candles as bars, state

    state.use_rocksdb(spark)
    for chunk in chunks:
        chunk.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(chunk.schema).parquet(f"{root}/in")
        bars.write_bars(make(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


def q_feature_stream(spark, sf_dir):
    """Features kept in a stream of three batches: bars of three days of the first come with the third; then the current rows."""
    from barloom.streaming.candles import current_bars
    from barloom.streaming.state import KEPT, feature_stream

    bars = candles.hourly(spark, sf_dir).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    day, held = F.dayofmonth("timestamp_utc"), F.dayofmonth("timestamp_utc").between(8, 10) & (F.hour("timestamp_utc") % 8 == 3)
    chunks = [bars.where((day <= 10) & ~held), bars.where((day > 10) & (day <= 20)), bars.where((day > 20) | held)]
    path = _streamed(spark, chunks, feature_stream, new_path(spark, "features"))
    out = current_bars(spark, path).select("pair", F.col("timestamp_utc").cast("timestamp_ntz").alias("timestamp_utc"), *KEPT)
    return tidy(out)


def q_release_hours(spark, sf_dir):
    """Hours of events that go out with all five types, or two hours late without; some purchases come after all other events."""
    from barloom.streaming.state import release_hours

    events = candles.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"))
    day, held = F.dayofmonth("ts"), (F.col("pair") == "purchase") & (F.hour("ts") % 6 == 0) & (F.dayofmonth("ts") % 2 == 0)
    chunks = [events.where((day <= 10) & ~held), events.where((day > 10) & (day <= 20) & ~held), events.where((day > 20) & ~held), events.where(held)]
    path = _streamed(spark, chunks, lambda s: release_hours(s, expected=5, late="2 hours"), new_path(spark, "hours"))
    return spark.read.parquet(path).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "bars", "reason")


DAYS = "date_format(timestamp_utc, 'yyyy-MM-dd')"


def q_stored_update(spark, sf_dir):
    """The update of ``join_update`` on a stored table of a part a day: one part is written anew; then the table, reread."""
    bars = candles.hourly(spark, sf_dir)
    table = StoredTable(spark, new_path(spark, "stored"), DAYS)
    table.create(bars)
    day = candles.in_range(bars, "2024-01-10", "2024-01-10 23:00:00")
    table.update(day.select("pair", "timestamp_utc", F.when(F.hour("timestamp_utc") % 2 == 0, F.col("volume") * 10).alias("volume")))
    return tidy(table.read())


def q_stored_insert(spark, sf_dir):
    """Bars of the first weeks stored, then all bars inserted twice: each is there once, and the first version is still to be read."""
    bars = candles.hourly(spark, sf_dir)
    table = StoredTable(spark, new_path(spark, "stored"), DAYS)
    table.create(candles.in_range(bars, "2024-01-01", "2024-01-22 23:00:00"))
    table.insert(bars.unionByName(bars))
    old = table.read(version=0).groupBy("pair").agg(F.count(F.lit(1)).alias("before"))
    new = table.read().groupBy("pair").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("timestamp_utc").alias("newest"))
    return tidy(new.join(old, "pair"))


def q_stored_scan(spark, sf_dir):
    """One pair and week of a stored table of all users' bars: the manifest names the files that may have them."""
    bars = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 hour", "user_id")
    table = StoredTable(spark, new_path(spark, "stored"), DAYS)
    table.create(bars)
    return tidy(table.read("17", "2024-01-05", "2024-01-12"))


def _known_split(spark, sf_dir):
    bars = candles.candles_from_events(candles.read_table(spark, sf_dir, "events"), "1 hour", "user_id")
    return candles.in_range(bars, "2024-01-01", "2024-01-22 23:00:00"), bars.unionByName(bars)


def q_insert_unknown(spark, sf_dir):
    """What a second fetch of all users' bars adds, told by Bloom filters of known keys by month."""
    have, new = _known_split(spark, sf_dir)
    month = F.date_format("timestamp_utc", "yyyy-MM")
    path = new_path(spark, "key-filter")
    build_filter(have, period=month).write.parquet(path)
    known = spark.read.parquet(path)
    return tidy(insert_unknown(have, new, known, period=month))


def _flat(rows):
    """Results with their maps and lists as texts, to be compared."""
    issues = F.array_join(F.transform("issues", lambda x: F.concat_ws("|", x["issue_type"], x["column"], F.date_format(x["timestamp"], "yyyy-MM-dd HH:mm:ss"), F.round(x["actual"], 4).cast("decimal(20,4)").cast("string"))), ";")
    summary = F.array_join(F.transform(F.map_entries("issue_summary"), lambda x: F.concat(x["key"], F.lit(":"), x["value"]["count"])), ",")
    return rows.select("pair", "status", "issues_count", "candles_count", F.round("issue_percentage", 6).alias("issue_percentage"), summary.alias("summary"), issues.alias("issues"))


def q_validation_results(spark, sf_dir):
    """Line items read as bars, and a pair without any: one nested row a pair, written as JSON and read back."""
    li = candles.read_table(spark, sf_dir, "lineitem")
    bars = li.select(F.concat("l_returnflag", "l_linestatus").alias("pair"), F.timestamp_seconds(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("timestamp_ntz").alias("timestamp_utc"), F.col("l_extendedprice").alias("open"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("high"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("low"), (F.col("l_quantity") * 1000).alias("close"), (F.col("l_quantity") - 2).alias("volume"))
    listed = candles.read_table(spark, sf_dir, "region").select(F.col("r_name").alias("pair"))
    path = new_path(spark, "results")
    validators.write_results(validators.results(bars, "raw_ohlcv", lambda d: (d, validators.raw_checks(d.columns)), listed), path)
    return _flat(validators.read_results(spark, path))


def q_validation_gaps(spark, sf_dir):
    """Gaps of hourly bars with ten examples a pair; the same bars without volume only have a status."""
    bars = candles.hourly(spark, sf_dir)
    gappy = validators.results(bars.where("hour(timestamp_utc) not in (3, 4)"), "completeness", validators.completeness_checks)
    less = validators.results(bars.drop("volume"), "raw_ohlcv", lambda d: (d, validators.raw_checks(d.columns)))
    return _flat(gappy.unionByName(less))


QUERIES = {
    "validation_results": q_validation_results,
    "validation_gaps": q_validation_gaps,
    "stored_update": q_stored_update,
    "stored_insert": q_stored_insert,
    "stored_scan": q_stored_scan,
    "insert_unknown": q_insert_unknown,
    "feature_stream": q_feature_stream,
    "release_hours": q_release_hours,
    "recursive_by_slot": q_recursive_by_slot,
    "features_by_slot": q_features_by_slot,
    "rows_by_slot": q_rows_by_slot,
    "resource_rollup": q_resource_rollup,
    "duration_log": q_duration_log,
    "text_report": q_text_report,
    "recheck": q_recheck,
    "write_partitioned": q_write_partitioned,
    "write_bucketed": q_write_bucketed,
    "scan_listed": q_scan_listed,
    "parse_index_candles": q_parse_index_candles,
    **{f"validate_{name}": _planted(name) for name in ("momentum", "volatility", "volume", "recursive", "statistical", "patterns", "temporal", "labels")},
    "validate_cross_pair": q_validate_cross_pair,
    "validate_targets": q_validate_targets,
    "full_backfill_wide": q_full_backfill_wide,
    "clean_values": q_clean_values,
    "candles": q_candles,
    "candles_by_user": q_candles_by_user,
    "scan_pair": q_scan_pair,
    "scan_latest": q_scan_latest,
    "scan_trailing": q_scan_trailing,
    "pairs": q_pairs,
    "known_bounds": q_known_bounds,
    "parse_candles": q_parse_candles,
    "parse_funding": q_parse_funding,
    "price_action": _added(features.price_action),
    "momentum": _added(features.momentum),
    "momentum_recursive": _added(lambda d: recursive(d, PARAMS, MOMENTUM)),
    "volatility": _added(features.volatility),
    "volatility_recursive": _added(lambda d: recursive(d, PARAMS, VOLATILITY)),
    "volume": _added(features.volume),
    "volume_recursive": _added(lambda d: recursive(d, PARAMS, VOLUME)),
    "statistical": _added(lambda d: recursive(features.statistical(features.price_action(d)), PARAMS, STATISTICAL), "std_dev_returns_20", "skewness_20", "kurtosis_20", "z_score_20", "autocorr_1", "shannon_entropy", "hurst_exponent", "estimated_slippage_1h", "bid_ask_spread_1h"),
    "pattern": _added(features.pattern),
    "calendar": _added(features.calendar),
    "labels": _added(features.labels),
    "resample_4h": q_resample_4h,
    "resample_grid": q_resample_grid,
    "multi_timeframe": q_multi_timeframe,
    "multi_timeframe_grid": q_multi_timeframe_grid,
    "multi_timeframe_closed": q_multi_timeframe_closed,
    "cross_pair": q_cross_pair,
    "cross_section_wide": q_cross_section_wide,
    "asof_premium": q_asof_premium,
    "range_match": q_range_match,
    "gaps": q_gaps,
    "missing_hours": q_missing_hours,
    "missing_by_day": q_missing_by_day,
    "fill_gaps": q_fill_gaps,
    "insert_ignore": q_insert_ignore,
    "join_update": q_join_update,
    "completeness": q_completeness,
    "raw_ohlcv": q_raw_ohlcv,
    "sanity": q_sanity,
    "recompute": q_recompute,
    "validate_clean": q_validate_clean,
    "distributions": q_distributions,
    "distribution_issues": q_distribution_issues,
    "issue_grades": q_issue_grades,
    "top_offenders": q_top_offenders,
    "commonest_issues": q_commonest_issues,
    "issue_neighbourhood": q_issue_neighbourhood,
    "market_summary": q_market_summary,
    "movers": q_movers,
    "alerts": q_alerts,
    "duration_rollup": q_duration_rollup,
    "fetch_summary": q_fetch_summary,
    "session_time": q_session_time,
    "rolling_update": q_rolling_update,
    "streaming_candles": q_streaming_candles,
    "top_width": q_top_width,
    "full_backfill": q_full_backfill,
    "parse_trades": q_parse_trades,
    "new_trades": q_new_trades,
    "premium_history": q_premium_history,
    "chart_window": q_chart_window,
    "report_reader": q_report_reader,
    "performance": q_performance,
}
