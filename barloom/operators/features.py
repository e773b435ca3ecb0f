"""Feature groups that windows express. Each takes rows from ``numbered`` and adds its columns.

All of them use the window specification ``by_pair``, so that any set of groups costs one shuffle on the
pair and one sort. Warm-up rows hold each column's own constant, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import TINY, ahead, before, by_pair, from_row, lag, last_n, ratio, so_far, whole
from barloom.params import Labels, Momentum, Params, Pattern, Statistical, Volatility, Volume

def prices() -> tuple[Column, ...]:
    """Open, high, low, close and volume."""
    return tuple(map(F.col, ("open", "high", "low", "close", "volume")))


def change(now: Column, then: Column) -> Column:
    """now / then - 1 where then > 0, else 0."""
    return F.coalesce(F.when(then > 0, now / then - 1), F.lit(0.0))


def price_action(df: DataFrame, p: Params | None = None) -> DataFrame:
    O, H, L, C, V = prices()  # noqa: E741, N806
    body = F.abs(C - O)
    df = df.withColumns({
        "body_size": body,
        "candle_body_size": body,
        "upper_shadow": H - F.greatest(O, C),
        "lower_shadow": F.least(O, C) - L,
        "relative_close_position": ratio(C - L, H - L, 0.5),
        # Spark's log of 0 is null; a close of 0 after one above it is a return of minus infinity.
        "log_return": F.coalesce(F.when(lag(C) > 0, F.when(C / lag(C) == 0, float("-inf")).otherwise(F.log(C / lag(C)))), F.lit(0.0)),
        "gap_open": change(O, lag(C)),
        "prev_close_change_pct": change(C, lag(C)),
        "price_velocity": change(C, lag(C, 3)),
    })
    return df.withColumn("price_acceleration", from_row(6, F.col("price_velocity") - lag("price_velocity", 3)))


def momentum(df: DataFrame, p: Params | None = None) -> DataFrame:
    O, H, L, C, V = prices()  # noqa: E741, N806
    m = p.momentum if p else Momentum()
    df = df.withColumns({"__hh": F.max(H).over(last_n(m.stoch_k)), "__ll": F.min(L).over(last_n(m.stoch_k)), "__tp": (H + L + C) / 3, "__mid": (H + L) / 2})
    span = F.col("__hh") - F.col("__ll")
    df = df.withColumns({
        "stoch_k_14": from_row(m.stoch_k - 1, ratio(100 * (C - F.col("__ll")), span, 50.0)),
        "williams_r_14": from_row(m.williams - 1, ratio(-100 * (F.col("__hh") - C), span, -50.0)),
        "roc_10": from_row(m.roc, 100 * change(C, lag(C, m.roc))),
        "__tps": F.collect_list("__tp").over(last_n(m.cci)),
        "__mean": F.avg("__tp").over(last_n(m.cci)),
        "__fast": from_row(m.ao_fast - 1, F.avg("__mid").over(last_n(m.ao_fast))),
        "__slow": from_row(m.ao_slow - 1, F.avg("__mid").over(last_n(m.ao_slow))),
    })
    spread = F.aggregate("__tps", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("__mean"))) / F.size("__tps")
    df = df.withColumn("__mad", spread)
    df = df.withColumns({
        "stoch_d_14": from_row(m.stoch_d - 1, F.avg("stoch_k_14").over(last_n(m.stoch_d))),
        "cci_14": from_row(m.cci - 1, ratio(F.col("__tp") - F.col("__mean"), 0.015 * F.col("__mad"))),
        "awesome_oscillator": from_row(m.ao_fast - 1, F.col("__fast") - F.col("__slow")),
    })
    return df.drop("__hh", "__ll", "__tp", "__mid", "__tps", "__mean", "__mad", "__fast", "__slow")


def volatility(df: DataFrame, p: Params | None = None) -> DataFrame:
    O, H, L, C, V = prices()  # noqa: E741, N806
    v = p.volatility if p else Volatility()
    tr = F.greatest(H - L, F.coalesce(F.abs(H - lag(C)), H - L), F.coalesce(F.abs(L - lag(C)), H - L))
    wide = F.max(H).over(last_n(v.donchian)) - F.min(L).over(last_n(v.donchian))
    df = df.withColumns({
        "true_range": tr,
        "__ret": change(C, lag(C)),
        "__sma": F.avg(C).over(last_n(v.bollinger)),
        "__sd": F.stddev_pop(C).over(last_n(v.bollinger)),
        "__wide": wide,
    })
    band = 2 * v.bollinger_width * F.col("__sd")
    low = F.col("__sma") - v.bollinger_width * F.col("__sd")
    first = F.max(F.when(F.col("__i") == v.donchian - 1, F.col("__wide"))).over(whole())
    df = df.withColumns({
        "bollinger_width_1h": from_row(v.bollinger - 1, band),
        # Rounding leaves a band of about 1e-8 where all closes are equal; it counts as none.
        "bollinger_percent_b": from_row(v.bollinger - 1, F.when(band > 1e-6, (C - low) / band).otherwise(0.5), 0.5),
        "donchian_channel_width_1h": F.when(F.col("__i") >= v.donchian - 1, F.col("__wide")).otherwise(F.coalesce(first, F.lit(0.0))),
        "historical_vol_30": from_row(v.historical, F.stddev_pop("__ret").over(last_n(v.historical)) * (252.0**0.5)),
    })
    return df.drop("__ret", "__sma", "__sd", "__wide")


def volume(df: DataFrame, p: Params | None = None) -> DataFrame:
    O, H, L, C, V = prices()  # noqa: E741, N806
    q = p.volume if p else Volume()
    df = df.withColumns({"__tp": (H + L + C) / 3, "__pc": lag(C), "__pv": lag(V)})
    df = df.withColumn("__ptp", lag("__tp"))
    flow = F.col("__tp") * V
    up = F.when(F.col("__ptp").isNull(), 0.0).when(F.col("__tp") > F.col("__ptp"), flow).otherwise(0.0)
    down = F.when(F.col("__ptp").isNull(), 0.0).when(F.col("__tp") > F.col("__ptp"), 0.0).otherwise(flow)
    signed = F.when(F.col("__pc").isNull(), V).otherwise(F.signum(C - F.col("__pc")) * V)
    inside = F.when(H > L, ((C - L) - (H - C)) / (H - L)).otherwise(0.0)
    df = df.withColumns({
        "__up": F.sum(up).over(last_n(q.mfi)),
        "__down": F.sum(down).over(last_n(q.mfi)),
        "obv_1h": F.sum(signed).over(so_far()),
        "__cv": F.sum(C * V).over(last_n(q.vwma)),
        "__v": F.sum(V).over(last_n(q.vwma)),
        "__mv": F.sum(inside * V).over(last_n(q.cmf)),
        "__vc": F.sum(V).over(last_n(q.cmf)),
        "__reset": F.sum(F.when(F.col("__pc") <= 0, 1).otherwise(0)).over(so_far()),
    })
    step = F.coalesce(F.when(F.col("__pc") > 0, V * (C - F.col("__pc")) / F.col("__pc")), F.lit(0.0))
    since = Window.partitionBy("pair", "__reset").orderBy("timestamp_utc").rowsBetween(Window.unboundedPreceding, 0)
    same = F.signum(C - F.col("__pc")) == F.signum(V - F.col("__pv"))
    df = df.withColumns({
        "money_flow_index_1h": from_row(q.mfi, F.when(F.col("__down") > 0, 100 - 100 / (1 + F.col("__up") / F.col("__down"))).otherwise(100.0)),
        "obv_slope_1h": from_row(3, (F.col("obv_1h") - lag("obv_1h", 3)) / 3),
        "volume_change_pct_1h": F.coalesce(V / F.greatest(F.col("__pv"), F.lit(TINY)) - 1, F.lit(0.0)),
        "vwma_20": from_row(q.vwma - 1, ratio(F.col("__cv"), F.col("__v"), C), C),
        "chaikin_money_flow": from_row(q.cmf, ratio(F.col("__mv"), F.col("__vc"))),
        "volume_price_confirmation": F.when(same, 1.0).otherwise(0.0),
        "volume_price_trend": F.sum(step).over(since),
    })
    df = df.withColumn("volume_change_pct_1h", F.when(F.col("__i") == 0, 0.0).otherwise(F.col("volume_change_pct_1h")))
    return df.drop("__tp", "__pc", "__pv", "__ptp", "__up", "__down", "__cv", "__v", "__mv", "__vc", "__reset")


def statistical(df: DataFrame, p: Params | None = None) -> DataFrame:
    """Moments, z-score and autocorrelation; log_return must be there (``price_action``)."""
    O, H, L, C, V = prices()  # noqa: E741, N806
    s = p.statistical if p else Statistical()
    r, w = F.col("log_return"), last_n(s.window)
    df = df.withColumns({
        "__sd": F.stddev_pop(r).over(w),
        "__sk": F.skewness(r).over(w),
        "__ku": F.kurtosis(r).over(w),
        "__sma": F.avg(C).over(w),
        "__psd": F.stddev_pop(C).over(before(s.window)),
        "__rs": F.collect_list(r).over(w),
        "__m": F.avg(r).over(w),
        "__var": F.var_pop(r).over(w),
    })
    flat = 1e-9  # deviations below it are rounding
    pairs = F.zip_with(F.slice("__rs", 2, s.window), F.slice("__rs", 1, s.window - 1), lambda a, b: (a - F.col("__m")) * (b - F.col("__m")))
    auto = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (s.window - 1)
    df = df.withColumns({
        "std_dev_returns_20": from_row(s.window, F.col("__sd")),
        "skewness_20": from_row(s.window, F.when(F.col("__sd") > flat, F.col("__sk"))),
        "kurtosis_20": from_row(s.window, F.when(F.col("__sd") > flat, F.col("__ku"))),
        "z_score_20": from_row(s.window, F.when(F.col("__psd") > flat, (C - F.col("__sma")) / F.col("__psd"))),
        "autocorr_1": from_row(s.window, F.when(F.col("__sd") > flat, auto / F.col("__var"))),
        "estimated_slippage_1h": H - L,
        "bid_ask_spread_1h": 0.1 * (H - L),
    })
    return df.drop("__sd", "__sk", "__ku", "__sma", "__psd", "__rs", "__m", "__var")


def pattern(df: DataFrame, p: Params | None = None) -> DataFrame:
    O, H, L, C, V = prices()  # noqa: E741, N806
    q = p.pattern if p else Pattern()
    o1, c1, h1 = lag(O), lag(C), lag(H)
    o2, c2, h2, l2 = lag(O, 2), lag(C, 2), lag(H, 2), lag(L, 2)
    body, span = F.abs(C - O), H - L
    bull = (C > O) & (O < F.least(o1, c1)) & (C > F.greatest(o1, c1))
    bear = (C < O) & (O > F.greatest(o1, c1)) & (C < F.least(o1, c1))
    star = (c2 < o2) & (o2 - c2 > 0.5 * (h2 - l2)) & (F.abs(c1 - o1) < 0.3 * (o2 - c2)) & (h1 < c2) & (C > O) & (C > (o2 + c2) / 2)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("smallint")
    return df.withColumns({
        "pattern_doji": flag(body / F.greatest(span, F.lit(TINY)) < q.doji),
        "pattern_engulfing": flag(bull | bear),
        "pattern_hammer": flag((body < q.hammer_body * span) & (F.least(O, C) - L > q.hammer_shadow * body) & (H - F.greatest(O, C) < 0.1 * span)),
        "pattern_morning_star": flag(star),
        "resistance_level": F.when(F.col("__i") >= q.levels, F.max(H).over(before(q.levels))).otherwise(F.first(H).over(whole())),
        "support_level": F.when(F.col("__i") >= q.levels, F.min(L).over(before(q.levels))).otherwise(F.first(L).over(whole())),
    })


def calendar(df: DataFrame, p: Params | None = None) -> DataFrame:
    t = F.col("timestamp_utc")
    hour, day = F.hour(t), F.weekday(t)
    short = lambda c: c.cast("smallint")
    return df.withColumns({
        "hour_of_day": short(hour),
        "day_of_week": short(day),
        "month_of_year": short(F.month(t)),
        "is_weekend": short(((day == 4) & (hour >= 21)) | (day >= 5)),
        "asian_session": short(hour < 8),
        "european_session": short((hour >= 8) & (hour < 16)),
        "american_session": short((hour >= 14) & (hour < 22)),
    })


def labels(df: DataFrame, p: Params | None = None) -> DataFrame:
    """Forward-looking columns; the last rows, which lack their future, hold 0."""
    O, H, L, C, V = prices()  # noqa: E741, N806
    q = p.labels if p else Labels()
    left = F.col("__n") - 1 - F.col("__i")
    returns = {f"future_return_{name}_pct": F.coalesce(F.when(C > 0, (F.lead(C, k).over(by_pair()) - C) / C), F.lit(0.0)) for name, k in q.horizons}
    best = F.when((left >= q.max_return + 1) & (C > 0), (F.max(H).over(ahead(q.max_return)) - C) / C).otherwise(0.0)
    worst = F.when((left >= q.drawdown + 1) & (C > 0), (F.min(L).over(ahead(q.drawdown)) - C) / C).otherwise(0.0)
    df = df.withColumns(returns | {"future_max_return_24h_pct": best, "future_max_drawdown_12h_pct": worst})
    gain, drop, top = F.col("future_return_12h_pct"), F.col("future_max_drawdown_12h_pct"), F.col("future_max_return_24h_pct")
    return df.withColumns({
        "was_profitable_12h": (gain > 0).cast("smallint"),
        "future_risk_adj_return_12h": F.when(left >= 12, gain / F.greatest(F.abs(drop), F.lit(TINY))).otherwise(0.0),
        "profit_target_1pct": (top > 0.01).cast("smallint"),
        "profit_target_2pct": (top > 0.02).cast("smallint"),
        "features_computed": F.lit(True),
        "targets_computed": F.lit(True),
    })
