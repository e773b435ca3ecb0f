"""DuckDB SQL by query name. Built from common table expressions for the bars and their row numbers."""

from __future__ import annotations

import re

from barloom.plans.pipeline import DIGITS
from barloom.quality import rules

BARS = """candles AS (
  SELECT event_type AS pair, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp_utc, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
ROWS = BARS + """, x AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY pair) AS n, lag(close) OVER w AS c1, lag(close, 3) OVER w AS c3, lag(open) OVER w AS o1, lag(high) OVER w AS h1,
         lag(volume) OVER w AS v1, (high + low + close) / 3 AS tp
  FROM candles WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc))"""
W = "(PARTITION BY pair ORDER BY timestamp_utc"


def last(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"{W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def rounded(*cols: str, keys: str = "pair, timestamp_utc") -> str:
    """Keys, and each column rounded: 'expression AS name' or a name."""
    out = []
    for c in cols:
        e, _, name = c.rpartition(" AS ")
        out.append(f"round({e or name}, {DIGITS.get(name, 6)}) AS {name}")
    return ", ".join([keys, *out])


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


SQL: dict[str, str] = {}

SQL["candles"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles")
SQL["candles_by_user"] = f"""SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM (
  SELECT user_id::VARCHAR AS pair, CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp_utc, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
SQL["scan_pair"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE pair = 'click' AND timestamp_utc BETWEEN '2024-01-05' AND '2024-01-12'")
SQL["scan_latest"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles QUALIFY row_number() OVER (PARTITION BY pair ORDER BY timestamp_utc DESC) <= 100")
SQL["scan_trailing"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE timestamp_utc >= (SELECT max(timestamp_utc) - INTERVAL 7 DAY FROM candles)")
SQL["pairs"] = "SELECT DISTINCT event_type AS pair FROM events"
SQL["known_bounds"] = q(BARS, "SELECT pair, min(timestamp_utc) AS first_time, max(timestamp_utc) AS last_time, count(*) AS rows FROM candles GROUP BY pair")
SQL["parse_candles"] = q(ROWS, f"""SELECT pair || '-SWAP' AS symbol, epoch_ms(timestamp_utc) AS ms, {rounded('open', 'high', 'low', 'close', 'volume', keys='1 AS one').replace('1 AS one, ', '')},
  NULL::DOUBLE AS volume_ccy, NULL::DOUBLE AS volume_quote, true AS confirmed FROM x WHERE i % 5 <> 4""")
SQL["parse_funding"] = """SELECT event_id * 1000 AS ms, event_type || '-USDT-SWAP' AS symbol, round(value, 6) AS funding_rate,
  round(CASE WHEN (props->>'k')::INT % 2 = 0 THEN 0 ELSE value / 1000 END, 6) AS realized_rate, 'noRate' AS formula_type FROM events"""

SQL["price_action"] = q(ROWS + """, y AS (SELECT *, CASE WHEN c3 > 0 THEN close / c3 - 1 ELSE 0 END AS vel FROM x)""", f"""SELECT {rounded(
    'abs(close - open) AS body_size', 'abs(close - open) AS candle_body_size', 'high - greatest(open, close) AS upper_shadow', 'least(open, close) - low AS lower_shadow',
    'CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS relative_close_position', 'CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS log_return',
    'CASE WHEN c1 > 0 THEN open / c1 - 1 ELSE 0 END AS gap_open', 'CASE WHEN c1 > 0 THEN close / c1 - 1 ELSE 0 END AS prev_close_change_pct', 'vel AS price_velocity',
    f'CASE WHEN i >= 6 THEN vel - lag(vel, 3) OVER {W}) ELSE 0 END AS price_acceleration')} FROM y""")

SQL["momentum"] = q(ROWS + f""", y AS (SELECT *, max(high) OVER {last(14)} AS hh, min(low) OVER {last(14)} AS ll, lag(close, 10) OVER {W}) AS c10, avg(tp) OVER {last(14)} AS m, list(tp) OVER {last(14)} AS tps,
    CASE WHEN i >= 4 THEN avg((high + low) / 2) OVER {last(5)} ELSE 0 END AS fast, CASE WHEN i >= 33 THEN avg((high + low) / 2) OVER {last(34)} ELSE 0 END AS slow FROM x),
  z AS (SELECT *, CASE WHEN i < 13 THEN 0 WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) ELSE 50 END AS k, list_avg(list_transform(tps, lambda v: abs(v - m))) AS mad FROM y)""", f"""SELECT {rounded(
    'k AS stoch_k_14', f'CASE WHEN i >= 2 THEN avg(k) OVER {last(3)} ELSE 0 END AS stoch_d_14', 'CASE WHEN i < 13 THEN 0 WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) ELSE -50 END AS williams_r_14',
    'CASE WHEN i >= 13 AND mad > 0 THEN (tp - m) / (0.015 * mad) ELSE 0 END AS cci_14', 'CASE WHEN i >= 10 AND c10 > 0 THEN 100 * (close / c10 - 1) ELSE 0 END AS roc_10', 'CASE WHEN i >= 4 THEN fast - slow ELSE 0 END AS awesome_oscillator')} FROM z""")

SQL["volatility"] = q(ROWS + f""", y AS (SELECT *, avg(close) OVER {last(20)} AS sma, stddev_pop(close) OVER {last(20)} AS sd, max(high) OVER {last(20)} - min(low) OVER {last(20)} AS wide,
    CASE WHEN c1 > 0 THEN close / c1 - 1 ELSE 0 END AS ret FROM x),
  z AS (SELECT *, max(CASE WHEN i = 19 THEN wide END) OVER (PARTITION BY pair) AS first_wide, stddev_pop(ret) OVER {last(30)} AS hv FROM y)""", f"""SELECT {rounded(
    'greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS true_range', 'CASE WHEN i >= 19 THEN 4 * sd ELSE 0 END AS bollinger_width_1h',
    'CASE WHEN i >= 19 AND 4 * sd > 1e-6 THEN (close - (sma - 2 * sd)) / (4 * sd) ELSE 0.5 END AS bollinger_percent_b',
    'CASE WHEN i >= 19 THEN wide ELSE coalesce(first_wide, 0) END AS donchian_channel_width_1h', 'CASE WHEN i >= 30 THEN hv * sqrt(252) ELSE 0 END AS historical_vol_30')} FROM z""")

SQL["volume"] = q(ROWS + f""", y AS (SELECT *, lag(tp) OVER {W}) AS tp1, CASE WHEN i = 0 THEN volume ELSE sign(close - c1) * volume END AS signed,
    CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END AS inside, CASE WHEN c1 > 0 THEN volume * (close - c1) / c1 ELSE 0 END AS step, sum(CASE WHEN c1 <= 0 THEN 1 ELSE 0 END) OVER {W}) AS part FROM x),
  z AS (SELECT *, sum(CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END) OVER {last(14)} AS up, sum(CASE WHEN tp1 IS NULL OR tp > tp1 THEN 0 ELSE tp * volume END) OVER {last(14)} AS down,
    sum(signed) OVER {W} ROWS UNBOUNDED PRECEDING) AS obv, sum(close * volume) OVER {last(20)} AS cv, sum(volume) OVER {last(20)} AS sv, sum(inside * volume) OVER {last(20)} AS mv,
    sum(step) OVER (PARTITION BY pair, part ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING) AS vpt FROM y)""", f"""SELECT {rounded(
    'CASE WHEN i < 14 THEN 0 WHEN down > 0 THEN 100 - 100 / (1 + up / down) ELSE 100 END AS money_flow_index_1h', 'obv AS obv_1h', f'CASE WHEN i >= 3 THEN (obv - lag(obv, 3) OVER {W})) / 3 ELSE 0 END AS obv_slope_1h',
    'CASE WHEN i = 0 THEN 0 ELSE volume / greatest(v1, 1e-8) - 1 END AS volume_change_pct_1h', 'CASE WHEN i >= 19 AND sv > 0 THEN cv / sv ELSE close END AS vwma_20', 'CASE WHEN i >= 20 AND sv > 0 THEN mv / sv ELSE 0 END AS chaikin_money_flow',
    'CASE WHEN sign(close - c1) = sign(volume - v1) THEN 1.0 ELSE 0.0 END AS volume_price_confirmation', 'vpt AS volume_price_trend')} FROM z""")

# Exponential means by recursion over row numbers: all states of a row from those of the row before.
SMOOTH = """, y AS (SELECT *, close - coalesce(c1, close) AS dc, CASE WHEN i > 0 AND high > low THEN volume * (CASE WHEN high + low + close > lag(high + low + close) OVER w THEN 1 ELSE -1 END) * abs(((close - low) - (high - close)) / (high - low)) * 2 ELSE 0 END AS force,
    CASE WHEN i > 0 AND close > c1 THEN volume ELSE 0 END AS vup, CASE WHEN i > 0 AND close <= c1 THEN volume ELSE 0 END AS vdn,
    greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr FROM x WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc)),
  s AS (SELECT *, avg(greatest(dc, 0)) OVER (PARTITION BY pair ORDER BY timestamp_utc ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed_up, avg(greatest(-dc, 0)) OVER (PARTITION BY pair ORDER BY timestamp_utc ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed_dn,
    avg(tr) OVER (PARTITION BY pair ORDER BY timestamp_utc ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed_tr FROM y),
  r AS (SELECT pair, i, close::DOUBLE AS e12, close::DOUBLE AS e26, 0::DOUBLE AS sig, dc::DOUBLE AS a, dc::DOUBLE AS b, abs(dc)::DOUBLE AS p, abs(dc)::DOUBLE AS g, force::DOUBLE AS k34, force::DOUBLE AS k55, volume AS v14, volume AS v28,
      vup::DOUBLE AS u, vdn::DOUBLE AS d, (high - low)::DOUBLE AS hl, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0::DOUBLE AS atr FROM s WHERE i = 0
    UNION ALL SELECT pair, i, e12, e26, 0.2 * (e12 - e26) + 0.8 * sig0, a, 2.0 / 26 * a + 24.0 / 26 * b0, p, 2.0 / 26 * p + 24.0 / 26 * g0, k34, k55, v14, v28, u, d, hl, up, dn, atr FROM (
      SELECT s.pair, s.i, 2.0 / 13 * close + 11.0 / 13 * e12 AS e12, 2.0 / 27 * close + 25.0 / 27 * e26 AS e26, sig AS sig0, 2.0 / 14 * dc + 12.0 / 14 * a AS a, b AS b0, 2.0 / 14 * abs(dc) + 12.0 / 14 * p AS p, g AS g0,
        2.0 / 35 * force + 33.0 / 35 * k34 AS k34, 2.0 / 56 * force + 54.0 / 56 * k55 AS k55, 2.0 / 15 * volume + 13.0 / 15 * v14 AS v14, 2.0 / 29 * volume + 27.0 / 29 * v28 AS v28,
        2.0 / 15 * vup + 13.0 / 15 * u AS u, 2.0 / 15 * vdn + 13.0 / 15 * d AS d, 2.0 / 11 * (high - low) + 9.0 / 11 * hl AS hl,
        CASE WHEN s.i < 14 THEN 0 WHEN s.i = 14 THEN seed_up ELSE (13 * up + greatest(dc, 0)) / 14 END AS up, CASE WHEN s.i < 14 THEN 0 WHEN s.i = 14 THEN seed_dn ELSE (13 * dn + greatest(-dc, 0)) / 14 END AS dn,
        CASE WHEN s.n <= 14 OR s.i < 13 THEN 0 WHEN s.i = 13 THEN seed_tr ELSE (13 * atr + tr) / 14 END AS atr
      FROM r JOIN s ON s.pair = r.pair AND s.i = r.i + 1)),
  t AS (SELECT x.*, r.* EXCLUDE (pair, i), CASE WHEN x.n <= 14 OR x.i < 14 THEN 50 WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) ELSE 100 END AS rsi, lag(hl) OVER w AS hl1, e12 - e26 AS macd, lag(e12 - e26) OVER w AS macd1,
      e12 - e26 - sig AS hist, lag(e12 - e26 - sig) OVER w AS hist1 FROM x JOIN r ON x.pair = r.pair AND x.i = r.i WINDOW w AS (PARTITION BY x.pair ORDER BY x.timestamp_utc))"""
RECURSE = "RECURSIVE " + ROWS + SMOOTH
SQL["momentum_recursive"] = q(RECURSE, f"""SELECT {rounded('rsi AS rsi_1h', f'CASE WHEN i >= 3 THEN (rsi - lag(rsi, 3) OVER {W})) / 3 ELSE 0 END AS rsi_slope_1h', 'coalesce(macd - macd1, 0) AS macd_slope_1h',
    'coalesce(hist - hist1, 0) AS macd_hist_slope_1h', 'CASE WHEN g <> 0 THEN 100 * b / g ELSE 0 END AS tsi', 'CASE WHEN e26 > 0 THEN 100 * (e12 - e26) / e26 ELSE 0 END AS ppo')} FROM t""")
SAR = """, px AS (SELECT *, lag(low, 2) OVER w AS l2, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lead(close) OVER w AS cn FROM x WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc)),
  ps AS (SELECT pair, i, CASE WHEN cn > close THEN 1 ELSE -1 END AS dir, (CASE WHEN cn > close THEN low ELSE high END)::DOUBLE AS sar, (CASE WHEN cn > close THEN high ELSE low END)::DOUBLE AS ep, 0.02::DOUBLE AS af FROM px WHERE i = 0
    UNION ALL SELECT pair, i, CASE WHEN turn THEN -dir ELSE dir END, CASE WHEN turn THEN ep ELSE stop END,
        CASE WHEN turn THEN CASE WHEN dir > 0 THEN low ELSE high END WHEN better THEN CASE WHEN dir > 0 THEN high ELSE low END ELSE ep END,
        CASE WHEN turn THEN 0.02 WHEN better THEN least(af + 0.02, 0.2) ELSE af END
      FROM (SELECT *, CASE WHEN dir > 0 THEN low < stop ELSE high > stop END AS turn, CASE WHEN dir > 0 THEN high > ep ELSE low < ep END AS better
        FROM (SELECT px.pair, px.i, px.low, px.high, ps.dir, ps.ep, ps.af, CASE WHEN ps.dir > 0 THEN least(ps.sar + ps.af * (ps.ep - ps.sar), px.l1, coalesce(px.l2, px.l1)) ELSE greatest(ps.sar + ps.af * (ps.ep - ps.sar), px.h1, coalesce(px.h2, px.h1)) END AS stop
          FROM ps JOIN px ON px.pair = ps.pair AND px.i = ps.i + 1)))"""
SQL["volatility_recursive"] = q(RECURSE + SAR, f"""SELECT {rounded('atr AS atr_1h', 'CASE WHEN close > 0 THEN atr / close ELSE 0 END AS normalized_atr_14', '4 * atr AS keltner_channel_width',
    'CASE WHEN i = 0 THEN 0 ELSE hl / greatest(hl1, 1e-8) - 1 END AS chaikin_volatility', 'CASE WHEN n >= 2 THEN sar ELSE 0 END AS parabolic_sar_1h', keys='t.pair, t.timestamp_utc')} FROM t JOIN ps USING (pair, i)""")
SQL["volume_recursive"] = q(RECURSE, f"SELECT {rounded('k34 - k55 AS klinger_oscillator', 'v14 - v28 AS volume_oscillator', 'CASE WHEN v14 > 0 THEN 100 * (u - d) / v14 ELSE 0 END AS volume_zone_oscillator')} FROM t")

SQL["statistical"] = q(ROWS + f""", y AS (SELECT *, CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS lr, ln(greatest(close, 1e-8)) AS lc FROM x),
  z AS (SELECT *, stddev_pop(lr) OVER {last(20)} AS sd, avg(lr) OVER {last(20)} AS m, list(lr) OVER {last(20)} AS rs, avg(close) OVER {last(20)} AS sma, stddev_pop(close) OVER {prior(20)} AS psd,
    list(lc) OVER {prior(20)} AS ps, list(lc) OVER {prior(100)} AS hs FROM y),
  d AS (SELECT *, list_avg(list_transform(rs, lambda v: power(v - m, 3))) AS m3, list_avg(list_transform(rs, lambda v: power(v - m, 4))) AS m4,
    list_sum(list_transform(range(2, 21), lambda j: (rs[j] - m) * (rs[j - 1] - m))) / 19 AS ac,
    list_transform(range(2, len(ps) + 1), lambda j: ps[j] - ps[j - 1]) AS pr, list_transform(range(2, len(hs) + 1), lambda j: hs[j] - hs[j - 1]) AS hr FROM z),
  e AS (SELECT *, list_min(pr) AS lo, greatest(list_max(pr) - list_min(pr), 1e-8) AS width,
    CASE WHEN i >= 100 THEN list_filter(list_transform(range(1, 21), lambda k: [ln(k), sqrt(list_avg(list_transform(range(1, 100 - k), lambda j: power(hr[j + k] - hr[j], 2))))]), lambda p: p[2] > 1e-12) END AS pts FROM d),
  f AS (SELECT *, list_transform(pr, lambda v: least(9, greatest(0, floor((v - lo) / width * 10)))::INT) AS bins, list_transform(pts, lambda p: [p[1], ln(p[2])]) AS xy FROM e),
  g AS (SELECT *, list_sum(list_transform(range(0, 10), lambda b: CASE WHEN len(list_filter(bins, lambda v: v = b)) > 0 THEN -(len(list_filter(bins, lambda v: v = b)) / len(bins)) * ln(len(list_filter(bins, lambda v: v = b)) / len(bins)) ELSE 0 END)) AS ent,
    list_avg(list_transform(xy, lambda p: p[1])) AS mx, list_avg(list_transform(xy, lambda p: p[2])) AS my FROM f),
  h AS (SELECT *, list_sum(list_transform(xy, lambda p: (p[1] - mx) * (p[2] - my))) / list_sum(list_transform(xy, lambda p: power(p[1] - mx, 2))) AS slope FROM g)""", f"""SELECT {rounded(
    'CASE WHEN i >= 20 THEN sd ELSE 0 END AS std_dev_returns_20', 'CASE WHEN i >= 20 AND sd > 1e-9 THEN m3 / power(sd, 3) ELSE 0 END AS skewness_20', 'CASE WHEN i >= 20 AND sd > 1e-9 THEN m4 / power(sd, 4) - 3 ELSE 0 END AS kurtosis_20',
    'CASE WHEN i >= 20 AND psd > 1e-9 THEN (close - sma) / psd ELSE 0 END AS z_score_20', 'CASE WHEN i >= 20 AND sd > 1e-9 THEN ac / (sd * sd) ELSE 0 END AS autocorr_1', 'CASE WHEN i >= 20 THEN ent ELSE 0 END AS shannon_entropy',
    'CASE WHEN n < 100 THEN 0.5 WHEN i < 100 THEN 0 WHEN len(xy) > 1 THEN least(1, greatest(0, slope / 2)) ELSE 0.5 END AS hurst_exponent', 'high - low AS estimated_slippage_1h', '0.1 * (high - low) AS bid_ask_spread_1h')} FROM h""")

SQL["pattern"] = q(ROWS + f""", y AS (SELECT *, lag(open, 2) OVER {W}) AS o2, lag(close, 2) OVER {W}) AS c2, lag(high, 2) OVER {W}) AS h2, lag(low, 2) OVER {W}) AS l2, max(high) OVER {prior(20)} AS res, min(low) OVER {prior(20)} AS sup,
    first_value(high) OVER {W}) AS fh, first_value(low) OVER {W}) AS fl FROM x)""", """SELECT pair, timestamp_utc,
    (abs(close - open) / greatest(high - low, 1e-8) < 0.1)::SMALLINT AS pattern_doji,
    coalesce((close > open AND open < least(o1, c1) AND close > greatest(o1, c1) AND c1 IS NOT NULL) OR (close < open AND open > greatest(o1, c1) AND close < least(o1, c1) AND c1 IS NOT NULL), false)::SMALLINT AS pattern_engulfing,
    (abs(close - open) < 0.3 * (high - low) AND least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < 0.1 * (high - low))::SMALLINT AS pattern_hammer,
    coalesce(c2 < o2 AND o2 - c2 > 0.5 * (h2 - l2) AND abs(c1 - o1) < 0.3 * (o2 - c2) AND h1 < c2 AND close > open AND close > (o2 + c2) / 2, false)::SMALLINT AS pattern_morning_star,
    round(CASE WHEN i >= 20 THEN res ELSE fh END, 6) AS resistance_level, round(CASE WHEN i >= 20 THEN sup ELSE fl END, 6) AS support_level FROM y""")
SQL["calendar"] = q(BARS + ", y AS (SELECT *, hour(timestamp_utc) AS h, isodow(timestamp_utc) - 1 AS d FROM candles)", """SELECT pair, timestamp_utc, h::SMALLINT AS hour_of_day, d::SMALLINT AS day_of_week, month(timestamp_utc)::SMALLINT AS month_of_year,
    ((d = 4 AND h >= 21) OR d >= 5)::SMALLINT AS is_weekend, (h < 8)::SMALLINT AS asian_session, (h >= 8 AND h < 16)::SMALLINT AS european_session, (h >= 14 AND h < 22)::SMALLINT AS american_session FROM y""")

_H = {"1h": 1, "4h": 4, "12h": 12, "1d": 24, "3d": 72, "1w": 168, "2w": 336}
LABELED = ROWS + ", y AS (SELECT *, n - 1 - i AS remaining, " + ", ".join(f"CASE WHEN close > 0 AND n - 1 - i >= {k} THEN (lead(close, {k}) OVER {W}) - close) / close ELSE 0 END AS future_return_{s}_pct" for s, k in _H.items()) + f""",
    CASE WHEN n - 1 - i >= 25 AND close > 0 THEN (max(high) OVER {W} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - close) / close ELSE 0 END AS future_max_return_24h_pct,
    CASE WHEN n - 1 - i >= 13 AND close > 0 THEN (min(low) OVER {W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) - close) / close ELSE 0 END AS future_max_drawdown_12h_pct FROM x)"""
SQL["labels"] = q(LABELED, f"""SELECT {rounded(*(f'future_return_{s}_pct' for s in _H), 'future_max_return_24h_pct', 'future_max_drawdown_12h_pct', 'CASE WHEN remaining >= 12 THEN future_return_12h_pct / greatest(abs(future_max_drawdown_12h_pct), 1e-8) ELSE 0 END AS future_risk_adj_return_12h')},
    (future_return_12h_pct > 0)::SMALLINT AS was_profitable_12h, (future_max_return_24h_pct > 0.01)::SMALLINT AS profit_target_1pct, (future_max_return_24h_pct > 0.02)::SMALLINT AS profit_target_2pct, true AS features_computed, true AS targets_computed FROM y""")


def higher(width: str, name: str) -> str:
    return f"""{name} AS (SELECT pair, time_bucket(INTERVAL '{width}', timestamp_utc) AS timestamp_utc, arg_min(open, timestamp_utc) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp_utc) AS close, sum(volume) AS volume, count(*) AS rows FROM candles GROUP BY 1, 2)"""


SQL["resample_4h"] = q(BARS + ", " + higher("4 hours", "b4"), f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')}, rows FROM b4")
SQL["resample_grid"] = q(BARS + ", " + higher("4 hours", "b4") + ", g AS (SELECT pair, unnest(generate_series(min(timestamp_utc), max(timestamp_utc), INTERVAL '4 hours')) AS timestamp_utc FROM b4 GROUP BY pair)",
    f"SELECT {rounded('open', 'high', 'low', 'close', 'coalesce(volume, 0) AS volume', keys='g.pair, g.timestamp_utc')} FROM g LEFT JOIN b4 USING (pair, timestamp_utc)")
SQL["multi_timeframe_closed"] = q(BARS + ", " + higher("4 hours", "a4") + ", " + higher("1 day", "a1") + ", b4 AS (FROM a4 QUALIFY count(*) OVER (PARTITION BY pair) >= 10), b1 AS (FROM a1 QUALIFY count(*) OVER (PARTITION BY pair) >= 7)",
    f"""SELECT {rounded('coalesce(b4.close, 0) AS close_4h', 'coalesce(b4.volume, 0) AS volume_4h', 'coalesce(b1.close, 0) AS close_1d', 'coalesce(b1.volume, 0) AS volume_1d', keys='c.pair, c.timestamp_utc')} FROM candles c
    LEFT JOIN b4 ON b4.pair = c.pair AND b4.timestamp_utc + INTERVAL '4 hours' = time_bucket(INTERVAL '4 hours', c.timestamp_utc) LEFT JOIN b1 ON b1.pair = c.pair AND b1.timestamp_utc + INTERVAL '1 day' = time_bucket(INTERVAL '1 day', c.timestamp_utc)""")


def frame_sql(name: str) -> str:
    """CTEs of the ten indicators on the bars ``f{name}``: r{name} recurses, t{name} has the columns."""
    k, daily = (1, True) if name == "1d" else (2, False)
    full = "" if daily else "CASE WHEN i < 19 THEN 0 ELSE "
    end = "" if daily else " END"
    return f"""x{name} AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY pair) AS n, lag(close) OVER w AS c1, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER w AS tp1, lag(volume) OVER w AS v1 FROM f{name} WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc)),
  s{name} AS (SELECT *, greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr, avg(greatest(close - c1, 0)) OVER {last(14)} AS seed_up, avg(greatest(c1 - close, 0)) OVER {last(14)} AS seed_dn FROM x{name}),
  r{name} AS (SELECT pair, i, close::DOUBLE AS e12, close::DOUBLE AS e26, 0::DOUBLE AS sig, tr::DOUBLE AS atr, 0::DOUBLE AS up, 0::DOUBLE AS dn FROM s{name} WHERE i = 0
    UNION ALL SELECT pair, i, e12, e26, 0.2 * (e12 - e26) + 0.8 * sig0, atr, up, dn FROM (
      SELECT s.pair, s.i, 2.0 / 13 * close + 11.0 / 13 * e12 AS e12, 2.0 / 27 * close + 25.0 / 27 * e26 AS e26, sig AS sig0, 2.0 / 15 * tr + 13.0 / 15 * atr AS atr,
        CASE WHEN s.i < 14 THEN 0 WHEN s.i = 14 THEN seed_up ELSE (13 * up + greatest(close - c1, 0)) / 14 END AS up, CASE WHEN s.i < 14 THEN 0 WHEN s.i = 14 THEN seed_dn ELSE (13 * dn + greatest(c1 - close, 0)) / 14 END AS dn
      FROM r{name} r JOIN s{name} s ON s.pair = r.pair AND s.i = r.i + 1)),
  u{name} AS (SELECT x.*, r.* EXCLUDE (pair, i), CASE WHEN x.n <= 14 OR x.i < 14 THEN 50 WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) ELSE 100 END AS rsi, e12 - e26 AS macd, e12 - e26 - sig AS hist,
      sum(CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END) OVER {last(14).replace('pair', 'x.pair').replace('timestamp_utc', 'x.timestamp_utc')} AS pos, sum(CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END) OVER {last(14).replace('pair', 'x.pair').replace('timestamp_utc', 'x.timestamp_utc')} AS neg,
      sum(CASE WHEN x.i = 0 THEN {'volume' if daily else '0'} ELSE sign(close - c1) * volume END) OVER {W.replace('pair', 'x.pair').replace('timestamp_utc', 'x.timestamp_utc')} ROWS UNBOUNDED PRECEDING) AS obv FROM x{name} x JOIN r{name} r ON x.pair = r.pair AND x.i = r.i),
  t{name} AS (SELECT pair, timestamp_utc, open AS open_{name}, high AS high_{name}, low AS low_{name}, close AS close_{name}, volume AS volume_{name}, rsi AS rsi_{name},
      CASE WHEN i >= {k} THEN (rsi - lag(rsi, {k}) OVER {W})) / {k} ELSE 0 END AS rsi_slope_{name}, coalesce(macd - lag(macd) OVER {W}), 0) AS macd_slope_{name}, coalesce(hist - lag(hist) OVER {W}), 0) AS macd_hist_slope_{name}, atr AS atr_{name},
      {full}coalesce(4 * stddev_samp(close) OVER {last(20)}, 0){end} AS bollinger_width_{name}, {full}max(high) OVER {last(20)} - min(low) OVER {last(20)}{end} AS donchian_channel_width_{name},
      CASE WHEN neg > 0{'' if daily else ' AND i >= 13'} THEN 100 - 100 / (1 + pos / neg) ELSE {'100' if daily else '100 - 100.0 / 101'} END AS money_flow_index_{name},
      CASE WHEN i >= {k} THEN (obv - lag(obv, {k}) OVER {W})) / {k} ELSE 0 END AS obv_slope_{name}, CASE WHEN v1 <> 0 THEN volume / v1 - 1 ELSE 0 END AS volume_change_pct_{name} FROM u{name})"""


_MTF = [f"{c}_{f}" for f in ("4h", "1d") for c in ("open", "high", "low", "close", "volume", "rsi", "rsi_slope", "macd_slope", "macd_hist_slope", "atr", "bollinger_width", "donchian_channel_width", "money_flow_index", "obv_slope", "volume_change_pct")]
SQL["multi_timeframe"] = q("RECURSIVE " + BARS + ", " + higher("4 hours", "a4") + ", " + higher("1 day", "a1") + ", f4h AS (FROM a4 QUALIFY count(*) OVER (PARTITION BY pair) >= 10), f1d AS (FROM a1 QUALIFY count(*) OVER (PARTITION BY pair) >= 7), " + frame_sql("4h") + ", " + frame_sql("1d"),
    f"""SELECT {rounded(*(f'coalesce({c}, 0) AS {c}' for c in _MTF), keys='c.pair, c.timestamp_utc')} FROM candles c
    LEFT JOIN t4h ON t4h.pair = c.pair AND t4h.timestamp_utc = time_bucket(INTERVAL '4 hours', c.timestamp_utc) LEFT JOIN t1d ON t1d.pair = c.pair AND t1d.timestamp_utc = time_bucket(INTERVAL '1 day', c.timestamp_utc)""")


def grid_sql(name: str, width: str, least: int) -> str:
    """CTEs of the ten indicators on the grid of bars ``f{name}``: g counts the empty bars since the last full one, k the changes between full ones."""
    j, daily = (1, True) if name == "1d" else (2, False)
    needs = "" if daily else f"CASE WHEN count(close) OVER {last(20)} < 20 THEN 0 ELSE "
    end = "" if daily else " END"
    of = lambda w: w.replace("pair", "x.pair").replace("timestamp_utc", "x.timestamp_utc")
    mean = lambda e, x, a: f"CASE WHEN close IS NULL THEN r.{e} ELSE (power(1 - {a}, g + 1) * r.{e} + {a} * {x}) / (power(1 - {a}, g + 1) + {a}) END AS {e}"
    return f"""f{name} AS (SELECT g.pair, g.timestamp_utc, open, high, low, close, coalesce(volume, 0) AS volume FROM (SELECT pair, unnest(generate_series(min(timestamp_utc), max(timestamp_utc), INTERVAL '{width}')) AS timestamp_utc FROM a{name} GROUP BY pair) g
      LEFT JOIN a{name} USING (pair, timestamp_utc) QUALIFY count(*) OVER (PARTITION BY g.pair) >= {least}),
  x{name} AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS c1, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER w AS tp1, lag(volume) OVER w AS v1 FROM f{name} WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc)),
  s{name} AS (SELECT *, greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr, count(close - c1) OVER w AS k, avg(CASE WHEN close - c1 IS NOT NULL THEN greatest(close - c1, 0) END) OVER w AS seed_up,
      avg(CASE WHEN close - c1 IS NOT NULL THEN greatest(c1 - close, 0) END) OVER w AS seed_dn FROM x{name} WINDOW w AS (PARTITION BY pair ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING)),
  r{name} AS (SELECT pair, i, close::DOUBLE AS e12, close::DOUBLE AS e26, 0::DOUBLE AS sig, tr::DOUBLE AS atr, 0 AS g, 0::DOUBLE AS up, 0::DOUBLE AS dn FROM s{name} WHERE i = 0
    UNION ALL SELECT pair, i, e12, e26, 0.2 * (e12 - e26) + 0.8 * sig0, atr, g, up, dn FROM (
      SELECT s.pair, s.i, {mean('e12', 'close', '(2.0::DOUBLE / 13)')}, {mean('e26', 'close', '(2.0::DOUBLE / 27)')}, r.sig AS sig0, {mean('atr', 'tr', '(2.0::DOUBLE / 15)')}, CASE WHEN close IS NULL THEN g + 1 ELSE 0 END AS g,
        CASE WHEN close - c1 IS NULL THEN up WHEN s.k < 14 THEN 0 WHEN s.k = 14 THEN seed_up ELSE (13 * up + greatest(close - c1, 0)) / 14 END AS up, CASE WHEN close - c1 IS NULL THEN dn WHEN s.k < 14 THEN 0 WHEN s.k = 14 THEN seed_dn ELSE (13 * dn + greatest(c1 - close, 0)) / 14 END AS dn
      FROM r{name} r JOIN s{name} s ON s.pair = r.pair AND s.i = r.i + 1)),
  u{name} AS (SELECT x.*, r.* EXCLUDE (pair, i, g), CASE WHEN x.k < 14 THEN 50 WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) ELSE 100 END AS rsi, e12 - e26 AS macd, e12 - e26 - sig AS hist,
      sum(CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END) OVER {of(last(14))} AS pos, sum(CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END) OVER {of(last(14))} AS neg,
      sum(CASE WHEN x.i = 0 THEN {'volume' if daily else '0'} ELSE coalesce(sign(close - c1), 0) * volume END) OVER {of(W)} ROWS UNBOUNDED PRECEDING) AS obv FROM s{name} x JOIN r{name} r ON x.pair = r.pair AND x.i = r.i),
  t{name} AS (SELECT pair, timestamp_utc, open AS open_{name}, high AS high_{name}, low AS low_{name}, close AS close_{name}, volume AS volume_{name}, rsi AS rsi_{name},
      CASE WHEN i >= {j} THEN (rsi - lag(rsi, {j}) OVER {W})) / {j} ELSE 0 END AS rsi_slope_{name}, coalesce(macd - lag(macd) OVER {W}), 0) AS macd_slope_{name}, coalesce(hist - lag(hist) OVER {W}), 0) AS macd_hist_slope_{name}, atr AS atr_{name},
      {needs}coalesce(4 * stddev_samp(close) OVER {last(20)}, 0){end} AS bollinger_width_{name}, {needs}coalesce(max(high) OVER {last(20)} - min(low) OVER {last(20)}, 0){end} AS donchian_channel_width_{name},
      CASE WHEN neg > 0{'' if daily else ' AND i >= 13'} THEN 100 - 100 / (1 + pos / neg) ELSE {'100' if daily else '100 - 100.0 / 101'} END AS money_flow_index_{name},
      CASE WHEN i >= {j} THEN (obv - lag(obv, {j}) OVER {W})) / {j} ELSE 0 END AS obv_slope_{name}, CASE WHEN v1 <> 0 THEN volume / v1 - 1 ELSE 0 END AS volume_change_pct_{name} FROM u{name})"""


_HOLED = BARS.replace("FROM events GROUP BY 1, 2", "FROM events WHERE (epoch(date_trunc('hour', ts)::TIMESTAMP)::BIGINT // 32400) % 3 <> 1 GROUP BY 1, 2")
SQL["multi_timeframe_grid"] = q("RECURSIVE " + _HOLED + ", " + higher("4 hours", "a4h") + ", " + higher("1 day", "a1d") + ", " + grid_sql("4h", "4 hours", 10) + ", " + grid_sql("1d", "1 day", 7),
    f"""SELECT {rounded(*(f'coalesce({c}, 0) AS {c}' for c in _MTF), keys='c.pair, c.timestamp_utc')} FROM candles c
    LEFT JOIN t4h ON t4h.pair = c.pair AND t4h.timestamp_utc = time_bucket(INTERVAL '4 hours', c.timestamp_utc) LEFT JOIN t1d ON t1d.pair = c.pair AND t1d.timestamp_utc = time_bucket(INTERVAL '1 day', c.timestamp_utc)""")


def rank_sql(c: str, positive: bool = True) -> str:
    """Rank in percent with averaged ties, rounded half to even."""
    place = f"(rank() OVER (PARTITION BY timestamp_utc ORDER BY {c} NULLS FIRST) - 1 + (count(*) OVER (PARTITION BY timestamp_utc, {c}) - 1) / 2)"
    r = f"CASE WHEN count(*) OVER (PARTITION BY timestamp_utc) = 1 THEN 50 ELSE 100 * {place} / (count(*) OVER (PARTITION BY timestamp_utc) - 1) END"
    r = f"CASE WHEN max({c}) OVER (PARTITION BY timestamp_utc) > 0 THEN {r} ELSE 50 END" if positive else r
    return f"round_even({r}, 0)::SMALLINT"


SQL["cross_pair"] = q(RECURSE + f""", lb AS (SELECT t.pair, t.timestamp_utc, t.volume, t.atr, t.i, CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS lr, CASE WHEN close > 0 AND n - 1 - i >= 1 THEN (lead(close) OVER {W}) - close) / close ELSE 0 END AS fr FROM t),
  bm AS (SELECT *, max(CASE WHEN pair = 'click' THEN fr END) OVER p AS btc, max(CASE WHEN pair = 'view' THEN fr END) OVER p AS eth, max(CASE WHEN pair = 'click' THEN lr END) OVER p AS base, count(*) OVER p AS m FROM lb WINDOW p AS (PARTITION BY timestamp_utc)),
  rel AS (SELECT *, CASE WHEN abs(btc) > 1e-9 THEN (fr - btc) / abs(btc) END AS rb, CASE WHEN abs(eth) > 1e-9 THEN (fr - eth) / abs(eth) END AS re, count(*) OVER w AS k, covar_pop(lr, base) OVER w AS cov, var_pop(lr) OVER w AS vx, var_pop(base) OVER w AS vy
    FROM bm WINDOW w AS (PARTITION BY pair, base IS NULL ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  rk AS (SELECT *, {rank_sql('volume')} AS volume_rank_1h, {rank_sql('atr')} AS volatility_rank_1h, CASE WHEN abs(btc) > 1e-9 AND m > 1 THEN {rank_sql('rb', False)} ELSE 0 END AS performance_rank_btc_1h, CASE WHEN abs(eth) > 1e-9 AND m > 1 THEN {rank_sql('re', False)} ELSE 0 END AS performance_rank_eth_1h FROM rel)""",
    f"""SELECT pair, timestamp_utc, volume_rank_1h, volatility_rank_1h, performance_rank_btc_1h::SMALLINT AS performance_rank_btc_1h, performance_rank_eth_1h::SMALLINT AS performance_rank_eth_1h,
    round(CASE WHEN pair = 'click' THEN 1 WHEN base IS NOT NULL AND k = 24 AND vx > 1e-18 AND vy > 1e-18 THEN cov / sqrt(vx * vy) ELSE 0 END, 6) AS btc_corr_24h, coalesce(lag(volume_rank_1h) OVER {W}), 0)::DOUBLE AS prev_volume_rank FROM rk""")
SQL["cross_section_wide"] = f"""WITH c AS (SELECT user_id::VARCHAR AS pair, CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp_utc, max(value) AS high, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)
  SELECT pair, timestamp_utc, {rank_sql('volume')} AS volume_rank, {rank_sql('high')} AS high_rank FROM c"""

PREMIUM = "premium AS (SELECT CASE WHEN event_type = 'purchase' THEN 'click' ELSE 'view' END AS pair, ts AS premium_time, value AS premium FROM events WHERE event_type IN ('purchase', 'error'))"
SQL["asof_premium"] = q(BARS + ", " + PREMIUM, "SELECT c.pair, c.timestamp_utc, round(c.close, 6) AS close, round(p.premium, 6) AS premium FROM candles c ASOF JOIN premium p ON c.pair = p.pair AND c.timestamp_utc >= p.premium_time")
SQL["range_match"] = q(BARS + ", " + PREMIUM, "SELECT c.pair, c.timestamp_utc, p.premium_time, round(p.premium, 6) AS premium FROM candles c JOIN premium p ON c.pair = p.pair AND abs(epoch_us(c.timestamp_utc) - epoch_us(p.premium_time)) <= 300000000")
GAPS = BARS + f", gp AS (SELECT pair, lag(timestamp_utc) OVER {W}) AS gap_start, timestamp_utc AS gap_end, (epoch(timestamp_utc) - epoch(lag(timestamp_utc) OVER {W}))) AS secs FROM candles QUALIFY secs > 3960)"
SQL["gaps"] = q(GAPS, "SELECT pair, gap_start, gap_end, (floor(secs / 3600) - 1)::BIGINT AS missing FROM gp")
MISSING = GAPS + ", ms AS (SELECT pair, unnest(generate_series(gap_start + INTERVAL 1 HOUR, gap_end - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS timestamp_utc FROM gp)"
SQL["missing_hours"] = q(MISSING, "SELECT pair, timestamp_utc FROM ms")
SQL["missing_by_day"] = q(MISSING, "SELECT timestamp_utc::DATE AS day, count(*) AS missing_hours, count(DISTINCT pair) AS pairs FROM ms GROUP BY 1")
SQL["fill_gaps"] = q(MISSING, """SELECT pair, timestamp_utc, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM candles WHERE pair = 'click'
  UNION ALL SELECT m.pair, m.timestamp_utc, round(v, 6), round(v, 6), round(v, 6), round(v, 6), 1.0 FROM (SELECT ms.pair, ms.timestamp_utc, arg_min(e.value, (abs(epoch_us(ms.timestamp_utc) - epoch_us(e.ts)), e.ts, e.value)) AS v
    FROM ms JOIN events e ON ms.pair = 'click' AND e.event_type <> 'click' AND abs(epoch_us(ms.timestamp_utc) - epoch_us(e.ts)) <= 300000000 GROUP BY 1, 2) m""")
SQL["insert_ignore"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE timestamp_utc > '2024-01-22 23:00:00'")
SQL["join_update"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', '''CASE WHEN timestamp_utc::DATE <> DATE '2024-01-10' THEN volume WHEN hour(timestamp_utc) % 2 = 0 THEN volume * 10 ELSE 0 END AS volume''')} FROM candles")

_LEAK = {"future_return_1h_pct": 1, "future_return_4h_pct": 4, "future_return_12h_pct": 12, "future_return_1d_pct": 24, "future_return_3d_pct": 72, "future_return_1w_pct": 168, "future_return_2w_pct": 336, "future_max_return_24h_pct": 24, "future_max_drawdown_12h_pct": 12}
ISSUES = LABELED + f""", c AS (SELECT *, max(timestamp_utc) OVER (PARTITION BY pair) AS newest, epoch(timestamp_utc) - epoch(lag(timestamp_utc) OVER {W})) AS secs FROM y),
  iss AS (SELECT pair, 'completeness' AS validator, 'null_values' AS issue_type, 'quote_volume' AS "column", count_if(hour(timestamp_utc) % 3 <> 0)::BIGINT AS issues, count(*) AS candles FROM c GROUP BY pair
  UNION ALL SELECT pair, 'completeness', 'gap', 'timestamp_utc', count_if(secs > 3960)::BIGINT, count(*) FROM c GROUP BY pair """ + " ".join(
    f"UNION ALL SELECT pair, 'completeness', 'label_leakage', '{k}', count_if(timestamp_utc > newest - INTERVAL {h} HOUR AND {k} <> 0)::BIGINT, count(*) FROM c GROUP BY pair" for k, h in _LEAK.items()) + ")"
SQL["completeness"] = q(ISSUES, "SELECT * FROM iss WHERE issues > 0")
SQL["issue_grades"] = q(ISSUES, """SELECT validator, issues, pairs_with_issues, pairs, CASE WHEN issues = 0 THEN 'PASSED' WHEN pairs_with_issues < 0.05 * pairs AND issues < 100 THEN 'MINOR' ELSE 'SIGNIFICANT' END AS grade
  FROM (SELECT validator, sum(issues)::BIGINT AS issues, count(DISTINCT pair) AS pairs_with_issues FROM iss WHERE issues > 0 GROUP BY validator), (SELECT count(DISTINCT pair) AS pairs FROM candles)""")
SQL["top_offenders"] = q(ISSUES, "SELECT pair, sum(issues)::BIGINT AS issues FROM iss WHERE issues > 0 GROUP BY pair ORDER BY issues DESC, pair LIMIT 20")
SQL["commonest_issues"] = q(ISSUES, "SELECT issue_type, sum(issues)::BIGINT AS issues FROM iss WHERE issues > 0 GROUP BY issue_type ORDER BY issues DESC, issue_type LIMIT 5")
_RAW = {("high_low_issues", "high"): "h < lo", ("open_high_issues", "open"): "h < o", ("low_close_issues", "low"): "lo > c", ("high_close_issues", "close"): "h < c", ("low_open_issues", "open"): "lo > o", ("negative_volume", "volume"): "v < 0", ("taker_buy_issues", "taker_buy_base"): "l_quantity > v"}
SQL["raw_ohlcv"] = "WITH b AS (SELECT l_returnflag AS pair, l_extendedprice AS o, l_extendedprice * (1 + l_tax) AS h, l_extendedprice * (1 - l_discount) AS lo, l_quantity * 1000 AS c, l_quantity - 2 AS v, l_quantity FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT pair, 'raw_ohlcv' AS validator, '{i}' AS issue_type, '{c}' AS \"column\", count_if({e})::BIGINT AS issues, count(*) AS candles FROM b GROUP BY pair" for (i, c), e in _RAW.items()) + ") WHERE issues > 0"


def _sanity() -> str:
    floats = ["open", "high", "low", "close", "volume", "log_return", "gap_open", "prev_close_change_pct", "future_return_1h_pct", "future_max_return_24h_pct", "rsi_1h"]
    bad = [("infinite_values", c, f"isinf({c})") for c in floats] + [("nan_values", c, f"isnan({c})") for c in floats]
    bad += [("range_violations", c, f"{c} < 0") for c in ("open", "high", "low", "close", "volume")] + [("range_violations", "rsi_1h", "rsi_1h < 0 OR rsi_1h > 100"), ("binary_violations", "pattern_doji", "pattern_doji NOT IN (0, 1)")]
    limit = {"volume": "100 * mv", "open": "10 * mo", "high": "10 * mh", "low": "10 * ml", "close": "10 * mc"} | {c: "2.0" for c in floats if c.endswith("_pct")}
    bad += [("absurd_values", c, f"{c} > {limit.get(c, '1e6')}") for c in [*floats, "pattern_doji"]]
    each = " UNION ALL ".join(f"SELECT pair, 'sanity' AS validator, '{i}' AS issue_type, '{c}' AS \"column\", count_if({e})::BIGINT AS issues, count(*) AS candles FROM z GROUP BY pair" for i, c, e in bad)
    return q(LABELED + """, z AS (SELECT *, CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS log_return, CASE WHEN c1 > 0 THEN open / c1 - 1 ELSE 0 END AS gap_open, CASE WHEN c1 > 0 THEN close / c1 - 1 ELSE 0 END AS prev_close_change_pct, close AS rsi_1h,
      (abs(close - open) / greatest(high - low, 1e-8) < 0.1)::INT AS pattern_doji, avg(volume) OVER p AS mv, avg(open) OVER p AS mo, avg(high) OVER p AS mh, avg(low) OVER p AS ml, avg(close) OVER p AS mc FROM y WINDOW p AS (PARTITION BY pair))""", f"SELECT * FROM ({each}) WHERE issues > 0")


SQL["sanity"] = _sanity()
SQL["recompute"] = q(ROWS, """SELECT pair, 'price_action' AS validator, 'calculation_mismatch' AS issue_type, unnest(['upper_shadow', 'gap_open']) AS "column", count_if(i % 7 = 3)::BIGINT AS issues, count(*) AS candles FROM x GROUP BY pair""")
SQL["validate_clean"] = q(BARS, "SELECT pair, count(*) AS candles, 0::BIGINT AS issues FROM candles GROUP BY pair")


def stats_sql(table: str, columns: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT pair, '{c}' AS \"column\", {c}::DOUBLE AS v FROM {table}" for c in columns)
    return f"""long AS ({long}), st AS (SELECT pair, "column", count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS least, max(v) AS most, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
      count_if(v = 0)::BIGINT AS zeros, count(DISTINCT v) AS "distinct", CASE WHEN count(*) > 2 AND stddev_pop(v) > 1e-9 THEN skewness(v) END AS skew, CASE WHEN count(*) > 3 AND stddev_pop(v) > 1e-9 THEN kurtosis(v) END AS kurt, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM long GROUP BY 1, 2),
    sx AS (SELECT st.*, (SELECT count(*) FROM long WHERE long.pair = st.pair AND long."column" = st."column" AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS outliers FROM st)"""


SQL["distributions"] = q(BARS + ", " + stats_sql("candles", ["open", "close", "volume"]), "SELECT " + rounded("mean", "median", "least", "most", "sd", "q1", "q3", "iqr", "skew", "kurt", keys='pair, "column", n, zeros, "distinct", outliers') + " FROM sx")
SQL["distribution_issues"] = q("li AS (SELECT *, l_returnflag AS pair, power(l_quantity / 10, 6) AS cube, CASE WHEN l_tax < 0.05 THEN 0.0 ELSE l_tax END AS rest, CASE WHEN l_quantity = 50 THEN l_extendedprice ELSE l_tax END AS rare FROM lineitem), " + stats_sql("li", ["l_quantity", "l_extendedprice", "cube", "rest", "rare"]), """SELECT pair, "column", 'high_zeros_percentage' AS issue_type, round(100 * zeros / n, 6) AS value FROM sx WHERE 100 * zeros / n > 40
  UNION ALL SELECT pair, "column", 'extreme_skewness', round(skew, 6) FROM sx WHERE abs(skew) > 10 UNION ALL SELECT pair, "column", 'high_outliers_percentage', round(100 * outliers / n, 6) FROM sx WHERE 100 * outliers / n > 5""")
SQL["issue_neighbourhood"] = q(GAPS, "SELECT gp.pair, gp.gap_end AS issue_time, c.timestamp_utc, round(c.close, 6) AS close FROM gp JOIN candles c ON c.pair = gp.pair AND c.timestamp_utc BETWEEN gp.gap_end - INTERVAL 5 HOUR AND gp.gap_end + INTERVAL 5 HOUR")


def summary_sql(source: str) -> str:
    return f"""dy AS (SELECT pair, date_trunc('day', timestamp_utc) AS d, arg_max(close, timestamp_utc) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2),
    dk AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY d DESC) AS k FROM dy), sm AS (SELECT pair, max(CASE WHEN k = 1 THEN close END) AS close, max(CASE WHEN k = 2 THEN close END) AS previous_close, max(CASE WHEN k = 1 THEN volume END) AS volume FROM dk WHERE k <= 2 GROUP BY pair),
    mk AS (SELECT *, CASE WHEN previous_close > 0 THEN 100 * (close / previous_close - 1) END AS change_pct FROM sm)"""


SQL["market_summary"] = q(BARS + ", " + summary_sql("candles"), f"SELECT {rounded('close', 'previous_close', 'volume', 'change_pct', keys='pair')} FROM mk")
SQL["movers"] = q("uc AS (SELECT user_id::VARCHAR AS pair, date_trunc('hour', ts) AS timestamp_utc, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2), " + summary_sql("uc"), " UNION ALL ".join(
    f"SELECT '{b}' AS board, place::INT AS place, pair, round(score, 6) AS score FROM (SELECT pair, {e} AS score, row_number() OVER (ORDER BY {e} DESC, pair) AS place FROM mk WHERE {e} IS NOT NULL) WHERE place <= 5" for b, e in (("gainers", "change_pct"), ("losers", "-change_pct"), ("volume", "volume"))))
SQL["alerts"] = q(RECURSE + f", a AS (SELECT pair, timestamp_utc, round(rsi, 6) AS rsi, round(coalesce(hist - hist1, 0), 6) AS m FROM t), b AS (SELECT *, lag(m) OVER {W}) AS m1 FROM a)", """SELECT pair, timestamp_utc, CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' END AS rsi_alert,
  CASE WHEN m1 <= 0 AND m > 0 THEN 'bullish' WHEN m1 >= 0 AND m < 0 THEN 'bearish' END AS macd_cross FROM b WHERE rsi_alert IS NOT NULL OR macd_cross IS NOT NULL""")
SQL["duration_rollup"] = "SELECT event_type AS operation, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(100 * sum(value) / (SELECT sum(value) FROM events), 6) AS share_pct FROM events GROUP BY 1"
SQL["fetch_summary"] = "SELECT sum(CASE WHEN event_type <> 'error' THEN (props->>'k')::BIGINT ELSE 0 END)::BIGINT AS inserted, count_if(event_type = 'error')::BIGINT AS errors, strftime(min(CASE WHEN event_type <> 'error' THEN ts END), '%Y-%m-%d %H:%M:%S') AS first_time FROM events"
SQL["session_time"] = q(BARS, "SELECT hour(timestamp_utc + INTERVAL 1 HOUR)::INT AS local_hour, count(*) AS bars, sum(volume) AS volume FROM candles GROUP BY 1")
SQL["rolling_update"] = q(ROWS + f""", y AS (SELECT *, CASE WHEN c3 > 0 THEN close / c3 - 1 ELSE 0 END AS vel, CASE WHEN c1 > 0 THEN close / c1 - 1 ELSE 0 END AS ret FROM x), z AS (SELECT *, stddev_pop(close) OVER {last(20)} AS sd, stddev_pop(ret) OVER {last(30)} AS hv, vel - lag(vel, 3) OVER {W}) AS acc FROM y)""", f"""SELECT {rounded(
    'CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS log_return', 'CASE WHEN i >= 6 THEN acc ELSE 0 END AS price_acceleration', 'greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS true_range', 'CASE WHEN i >= 19 THEN 4 * sd ELSE 0 END AS bollinger_width_1h', 'CASE WHEN i >= 30 THEN hv * sqrt(252) ELSE 0 END AS historical_vol_30')} FROM z WHERE n - i <= 200""")
SQL["streaming_candles"] = SQL["candles"]
SQL["top_width"] = q(ROWS + f", y AS (SELECT *, round(CASE WHEN i >= 19 THEN 4 * stddev_pop(close) OVER {last(20)} ELSE 0 END, 6) AS bw FROM x)", f"""SELECT {rounded('CASE WHEN c1 > 0 THEN ln(close / c1) ELSE 0 END AS log_return', 'greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS true_range')}, bw AS bollinger_width_1h,
  row_number() OVER (PARTITION BY pair ORDER BY bw DESC, timestamp_utc)::INT AS place FROM y QUALIFY place <= 10""")

SQL["parse_trades"] = """SELECT l_linestatus AS pair, l_orderkey::VARCHAR AS trade_id, round(l_extendedprice, 6) AS price, round(l_quantity, 6) AS quantity, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_partkey * 1000 AS ms FROM lineitem WHERE l_discount > 0"""
SQL["new_trades"] = "SELECT o_orderkey AS trade_id, o_orderstatus AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 <> 0)"
SQL["premium_history"] = q(BARS + ", " + PREMIUM + ", ph AS (SELECT pair, date_trunc('milliseconds', premium_time) AS premium_time, max(premium) AS premium FROM premium GROUP BY 1, 2)", "SELECT c.timestamp_utc, c.pair AS symbol, round(p.premium, 6) AS premium FROM candles c ASOF JOIN ph p ON c.pair = p.pair AND c.timestamp_utc >= p.premium_time")
SQL["chart_window"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE pair = 'view' AND timestamp_utc <= '2024-01-20' ORDER BY timestamp_utc DESC LIMIT 200")
SQL["report_reader"] = q(ISSUES, """SELECT pair, "column", issues, candles, 'check for zero volumes and repeated bars' AS hint FROM iss WHERE issues > 0 AND issue_type = 'null_values'""")
SQL["performance"] = q(BARS + """, tr AS (SELECT pair, timestamp_utc, least((close / open - 1) / 10, 0.5) AS r FROM candles WHERE open > 0), g AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY pair ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING)) AS cap FROM tr),
  pk AS (SELECT *, greatest(1, max(cap) OVER (PARTITION BY pair ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING)) AS peak FROM g)""", """SELECT pair, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, 1.0::DOUBLE AS mean_hours, round(avg(r) / stddev_samp(r), 6) AS sharpe, round(max(1 - cap / peak), 6) AS max_drawdown, round(sum(ln(1 + r)), 6) AS log_growth FROM pk GROUP BY pair""")

_ALL = ("price_action", "momentum", "volatility", "volume", "statistical", "pattern", "calendar", "labels", "momentum_recursive", "volatility_recursive", "volume_recursive", "multi_timeframe", "cross_pair")
SQL["full_backfill"] = "SELECT * FROM " + " JOIN ".join(f"({SQL[n]})" + ("" if k == 0 else " USING (pair, timestamp_utc)") for k, n in enumerate(_ALL))

SQL["scan_listed"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE pair <> 'error'")
SQL["parse_index_candles"] = q(ROWS, f"""SELECT pair || '-USDT' AS symbol, epoch_ms(timestamp_utc) AS ms, {rounded('open', 'high', 'low', 'close', keys='1 AS one').replace('1 AS one, ', '')},
  i % 4 <> 0 AS confirmed FROM x""")
#: Columns of each recomputing validator.
PLANTED = {
    "momentum": "stoch_k_14 williams_r_14 roc_10 stoch_d_14 cci_14 awesome_oscillator",
    "volatility": "true_range bollinger_width_1h bollinger_percent_b donchian_channel_width_1h historical_vol_30",
    "volume": "obv_1h money_flow_index_1h obv_slope_1h volume_change_pct_1h vwma_20 chaikin_money_flow volume_price_confirmation volume_price_trend",
    "recursive": "rsi_1h rsi_slope_1h macd_slope_1h macd_hist_slope_1h tsi ppo atr_1h normalized_atr_14 keltner_channel_width chaikin_volatility parabolic_sar_1h klinger_oscillator volume_oscillator volume_zone_oscillator hurst_exponent shannon_entropy",
    "statistical": "std_dev_returns_20 skewness_20 kurtosis_20 z_score_20 autocorr_1 estimated_slippage_1h bid_ask_spread_1h",
    "patterns": "pattern_doji pattern_engulfing pattern_hammer pattern_morning_star resistance_level support_level",
    "temporal": "hour_of_day day_of_week month_of_year is_weekend asian_session european_session american_session",
    "labels": "future_return_1h_pct future_return_4h_pct future_return_12h_pct future_return_1d_pct future_return_3d_pct future_return_1w_pct future_return_2w_pct future_max_return_24h_pct future_max_drawdown_12h_pct was_profitable_12h future_risk_adj_return_12h profit_target_1pct profit_target_2pct",
}
#: Bars whose close is moved where features were stored: by too little to be seen in some hours, by a hundredth or a half in others.
MOVED = BARS.replace("candles AS (", "unmoved AS (", 1) + """, candles AS (SELECT * REPLACE (close * CASE hour(timestamp_utc) % 7 WHEN 3 THEN 1.0000000001::DOUBLE WHEN 5 THEN 1.01::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS close) FROM unmoved)"""
_SOURCES = {"momentum": ("momentum",), "volatility": ("volatility",), "volume": ("volume",), "recursive": ("momentum_recursive", "volatility_recursive", "volume_recursive", "statistical"), "statistical": ("statistical",), "patterns": ("pattern",), "labels": ("labels",)}


def mismatches(name: str) -> str:
    """Features of the bars and of the moved bars, both stated in SQL, compared within each column's tolerance."""
    whole = lambda bars: " JOIN ".join(f"({re.sub(r', [3678]\) AS (\w+)', r', 13) AS \1', SQL[n].replace(BARS, bars))})" + ("" if k == 0 else " USING (pair, timestamp_utc)") for k, n in enumerate(_SOURCES[name]))
    apart = lambda c: f"coalesce(abs(b.{c}::DOUBLE - a.{c}::DOUBLE) > {rules.TOLERANCE.get(c, 1e-6)}, b.{c} IS NULL)"
    counts = ", ".join(f"count_if({apart(c)})::BIGINT AS {c}" for c in PLANTED[name].split())
    return f"""WITH a AS (SELECT * FROM {whole(BARS)}), b AS (SELECT * FROM {whole(MOVED)}), c AS (SELECT pair, count(*) AS candles, {counts} FROM a JOIN b USING (pair, timestamp_utc) GROUP BY pair)
  SELECT pair, '{name}' AS validator, 'calculation_mismatch' AS issue_type, "column", issues, candles FROM c UNPIVOT (issues FOR "column" IN ({PLANTED[name].replace(" ", ", ")})) WHERE issues > 0"""


for _name in _SOURCES:
    SQL[f"validate_{_name}"] = mismatches(_name)
SQL["validate_temporal"] = q(ROWS, f"""SELECT pair, 'temporal' AS validator, 'calculation_mismatch' AS issue_type, unnest({PLANTED['temporal'].split()}) AS "column", count_if(i % 7 = 3)::BIGINT AS issues, count(*) AS candles FROM x GROUP BY pair""")
_RANKS = ["volume_rank_1h", "volatility_rank_1h", "performance_rank_btc_1h", "performance_rank_eth_1h"]
SQL["validate_cross_pair"] = q(ROWS, f"""SELECT pair, 'cross_pair' AS validator, 'rank_range' AS issue_type, unnest({_RANKS}) AS "column", count_if(i % 11 = 2)::BIGINT AS issues, count(*) AS candles FROM x GROUP BY pair
  UNION ALL SELECT pair, 'cross_pair', 'correlation_range', 'btc_corr_24h', count_if(i % 13 = 5)::BIGINT, count(*) FROM x GROUP BY pair
  UNION ALL SELECT pair, 'cross_pair', 'benchmark_correlation', 'btc_corr_24h', count_if(i % 13 = 5)::BIGINT, count(*) FROM x WHERE pair = 'click' GROUP BY pair""")


def turned(column: str, k: int) -> str:
    return f"CASE WHEN i % {k} = 1 THEN 1 - {column} ELSE {column} END"


SQL["validate_targets"] = f"""WITH l AS ({SQL["labels"]}), r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY timestamp_utc) - 1 AS i FROM l),
  f AS (SELECT pair, future_max_return_24h_pct AS top, future_return_12h_pct AS gain, {turned("profit_target_1pct", 5)} AS p1, {turned("profit_target_2pct", 9)} AS p2, {turned("was_profitable_12h", 4)} AS w FROM r),
  c AS (SELECT pair, 'targets' AS validator, 'inconsistent_target' AS issue_type, 'profit_target_1pct' AS "column", count_if(p1 <> (top > 0.01)::INT)::BIGINT AS issues, count(*) AS candles FROM f GROUP BY pair
    UNION ALL SELECT pair, 'targets', 'inconsistent_target', 'profit_target_2pct', count_if(p2 <> (top > 0.02)::INT)::BIGINT, count(*) FROM f GROUP BY pair
    UNION ALL SELECT pair, 'targets', 'order_of_targets', 'profit_target_2pct', count_if(p2 > p1)::BIGINT, count(*) FROM f GROUP BY pair
    UNION ALL SELECT pair, 'labels', 'inconsistent_profit', 'was_profitable_12h', count_if(w <> (gain > 0)::INT)::BIGINT, count(*) FROM f GROUP BY pair)
  SELECT * FROM c WHERE issues > 0"""
SQL["full_backfill_wide"] = SQL["full_backfill"].replace("SELECT * FROM ", "SELECT * EXCLUDE (future_risk_adj_return_12h) FROM ", 1).replace("event_type AS pair", "user_id::VARCHAR AS pair").replace("'click'", "'1'").replace("'view'", "'2'")
SQL["clean_values"] = """SELECT l_orderkey AS pair, l_linenumber AS timestamp_utc, round(CASE WHEN l_linenumber > 3 THEN l_tax / l_quantity ELSE 0 END, 6) AS ratio,
  round_even(l_quantity / 2, 0)::SMALLINT AS volume_rank_1h FROM lineitem"""
SQL["resource_rollup"] = """SELECT operation, resource, count(*) AS n, round(avg(used), 6) AS mean, round(min(used), 6) AS least, round(max(used), 6) AS most FROM (
  SELECT l_returnflag AS operation, unnest(['cpu', 'memory', 'gpu']) AS resource, unnest([l_quantity, CASE WHEN l_discount > 0 THEN 100 * l_discount END, 100 * l_tax])::DOUBLE AS used FROM lineitem) WHERE used IS NOT NULL GROUP BY 1, 2"""
SQL["duration_log"] = SQL["duration_rollup"]
SQL["text_report"] = q(ISSUES, f"""SELECT 1::INT AS section, row_number() OVER (ORDER BY validator)::INT AS place, validator || ': ' || grade || ', ' || issues || ' issues in ' || pairs_with_issues || ' of ' || pairs || ' pairs' AS line FROM ({SQL["issue_grades"]})
  UNION ALL SELECT 2, row_number() OVER (ORDER BY issues DESC, pair)::INT, pair || ': ' || issues || ' issues' FROM ({SQL["top_offenders"]})
  UNION ALL SELECT 3, row_number() OVER (ORDER BY issues DESC, issue_type)::INT, issue_type || ': ' || issues FROM ({SQL["commonest_issues"]})""")
SQL["recheck"] = q(ROWS, """SELECT a.pair, a.timestamp_utc AS issue_time, 'upper_shadow' AS "column", b.timestamp_utc, round(b.high - greatest(b.open, b.close) + CASE WHEN b.i % 29 = 3 THEN 1 ELSE 0 END, 6) AS stored,
  round(b.high - greatest(b.open, b.close), 6) AS recomputed FROM x a JOIN x b ON a.pair = b.pair AND a.i % 29 = 3 AND b.timestamp_utc BETWEEN a.timestamp_utc - INTERVAL 5 HOUR AND a.timestamp_utc + INTERVAL 5 HOUR""")
SQL["write_partitioned"] = q(BARS, f"SELECT {rounded('open', 'high', 'low', 'close', '2 * volume AS volume')} FROM candles")
SQL["write_bucketed"] = SQL["scan_latest"]

#: All events as one-second bars of one pair.
ONE_PAIR = BARS.replace("event_type AS pair, CAST(date_trunc('hour', ts) AS TIMESTAMP)", "'all' AS pair, CAST(date_trunc('second', ts) AS TIMESTAMP)")


def _joined(*names: str) -> str:
    """The queries of ``names`` over the one pair, side by side."""
    return " JOIN ".join(f"({SQL[n].replace(BARS, ONE_PAIR)})" + ("" if k == 0 else " USING (pair, timestamp_utc)") for k, n in enumerate(names))


SQL["recursive_by_slot"] = f"""SELECT * EXCLUDE (parabolic_sar_1h, chaikin_volatility) FROM {_joined('momentum_recursive', 'volatility_recursive', 'volume_recursive')}
  JOIN (SELECT pair, timestamp_utc, obv_1h, obv_slope_1h, volume_price_trend FROM ({SQL['volume'].replace(BARS, ONE_PAIR)})) USING (pair, timestamp_utc)"""
SQL["features_by_slot"] = f"SELECT * FROM {_joined('price_action', 'momentum', 'volatility', 'volume', 'statistical', 'pattern', 'calendar', 'labels')}".replace("SELECT *", "SELECT * EXCLUDE (shannon_entropy, hurst_exponent)", 1)
SQL["rows_by_slot"] = q(BARS.replace("event_type AS pair, CAST(date_trunc('hour', ts) AS TIMESTAMP)", "user_id::VARCHAR AS pair, CAST(date_trunc('second', ts) AS TIMESTAMP)"),
    "SELECT pair, timestamp_utc, row_number() OVER (PARTITION BY pair ORDER BY timestamp_utc) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM candles")

SQL["feature_stream"] = f"""SELECT m.*, v.* EXCLUDE (pair, timestamp_utc, parabolic_sar_1h), q.* EXCLUDE (pair, timestamp_utc), o.obv_1h, o.obv_slope_1h, o.volume_price_trend, s.hurst_exponent, s.shannon_entropy
  FROM ({SQL['momentum_recursive']}) m JOIN ({SQL['volatility_recursive']}) v USING (pair, timestamp_utc) JOIN ({SQL['volume_recursive']}) q USING (pair, timestamp_utc)
  JOIN ({SQL['volume']}) o USING (pair, timestamp_utc) JOIN ({SQL['statistical']}) s USING (pair, timestamp_utc)"""
# An hour has all its types in one batch, but for the purchases held back, which the watermark no longer lets in.
SQL["release_hours"] = """WITH e AS (SELECT event_type, ts, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type = 'purchase' AND hour(ts) % 6 = 0 AND day(ts) % 2 = 0 AS held FROM events),
  m AS (SELECT max(ts) FILTER (NOT held) - INTERVAL 2 HOURS AS seen, max(ts) - INTERVAL 2 HOURS AS last FROM e),
  h AS (SELECT hour, count(DISTINCT event_type) AS bars FROM e, m WHERE NOT held OR ts > seen GROUP BY hour)
  SELECT hour, bars, CASE WHEN bars >= 5 THEN 'complete' ELSE 'deadline' END AS reason FROM h, m WHERE bars >= 5 OR hour + INTERVAL 1 HOUR <= last"""

#: Hourly bars of users.
USERS = BARS.replace("event_type AS pair", "user_id::VARCHAR AS pair")
SQL["stored_update"] = SQL["join_update"]
SQL["stored_insert"] = q(BARS, """SELECT pair, count(*) AS bars, sum(volume) AS volume, max(timestamp_utc) AS newest, count(*) FILTER (timestamp_utc <= TIMESTAMP '2024-01-22 23:00:00') AS before
  FROM candles GROUP BY pair HAVING before > 0""")
SQL["stored_scan"] = q(USERS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE pair = '17' AND timestamp_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
SQL["insert_unknown"] = q(USERS, f"SELECT {rounded('open', 'high', 'low', 'close', 'volume')} FROM candles WHERE timestamp_utc > TIMESTAMP '2024-01-22 23:00:00'")

#: Checks of bars by number: type of issue, column, condition.
_RAW = (("high_low_issues", "high", "high < low"), ("open_high_issues", "open", "high < open"), ("low_close_issues", "low", "low > close"), ("high_close_issues", "close", "high < close"), ("low_open_issues", "open", "low > open"), ("negative_volume", "volume", "volume < 0"))
SQL["validation_results"] = q("""b AS (SELECT l_returnflag || l_linestatus AS pair, make_timestamp((l_orderkey * 10 + l_linenumber) * 1000000) AS t, l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high,
    l_extendedprice * (1 - l_discount) AS low, l_quantity * 1000 AS close, l_quantity - 2 AS volume FROM lineitem),
  h AS (""" + " UNION ALL ".join(f"SELECT pair, t, {k} AS i, '{n}' AS kind, '{c}' AS col, {c}::DOUBLE AS v FROM b WHERE {w}" for k, (n, c, w) in enumerate(_RAW)) + """),
  s AS (SELECT pair, sum(n)::BIGINT AS issues_count, string_agg(kind || ':' || n, ',' ORDER BY kind) AS summary FROM (SELECT pair, kind, count(*) AS n FROM h GROUP BY ALL) GROUP BY pair),
  e AS (SELECT pair, string_agg(kind || '|' || col || '|' || strftime(t, '%Y-%m-%d %H:%M:%S') || '|' || round(v, 4)::DECIMAL(20, 4), ';' ORDER BY i, k) AS issues
    FROM (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY t, v) AS k FROM h) WHERE k <= 5 GROUP BY pair),
  n AS (SELECT pair, count(*) AS candles_count FROM b GROUP BY pair)""", """SELECT pair, 'completed' AS status, coalesce(issues_count, 0) AS issues_count, candles_count, round(100.0::DOUBLE * coalesce(issues_count, 0) / candles_count, 6) AS issue_percentage, coalesce(summary, '') AS summary, coalesce(issues, '') AS issues
  FROM n LEFT JOIN s USING (pair) LEFT JOIN e USING (pair) UNION ALL SELECT r_name, 'no_data', 0, 0, 0, '', '' FROM region WHERE r_name NOT IN (SELECT pair FROM b)""")
SQL["validation_gaps"] = q(BARS + """, b AS (SELECT *, timestamp_utc - lag(timestamp_utc) OVER (PARTITION BY pair ORDER BY timestamp_utc) > INTERVAL 66 MINUTES AS gap FROM candles WHERE hour(timestamp_utc) NOT IN (3, 4)),
  e AS (SELECT pair, string_agg('gap|timestamp_utc|' || strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S'), ';' ORDER BY timestamp_utc) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY timestamp_utc) AS k FROM b WHERE gap) WHERE k <= 10 GROUP BY pair),
  n AS (SELECT pair, count(*) FILTER (gap) AS g, count(*) AS c FROM b GROUP BY pair)""", """SELECT pair, 'completed' AS status, g AS issues_count, c AS candles_count, round(100.0::DOUBLE * g / c, 6) AS issue_percentage, CASE WHEN g > 0 THEN 'gap:' || g ELSE '' END AS summary, coalesce(issues, '') AS issues
  FROM n LEFT JOIN e USING (pair) UNION ALL SELECT pair, 'missing_columns', 0, count(*), 0, '', '' FROM candles GROUP BY pair""")
