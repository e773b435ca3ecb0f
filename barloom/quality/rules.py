"""Ranges and feature groups that validators check. Fixed values."""

#: (columns, least, greatest)
RANGES = (
    (("rsi_1h", "rsi_4h", "rsi_1d", "stoch_k_14", "stoch_d_14", "money_flow_index_1h"), 0, 100),
    (("btc_corr_24h", "autocorr_1"), -1, 1),
    (("volume_rank_1h", "volatility_rank_1h", "performance_rank_btc_1h", "performance_rank_eth_1h"), 0, 100),
    (("hurst_exponent",), 0, 1),
    (("shannon_entropy",), 0, None),
    (("hour_of_day",), 0, 23),
    (("day_of_week",), 0, 6),
    (("month_of_year",), 1, 12),
    (("volume", "open", "high", "low", "close", "atr_1h", "bollinger_width_1h", "donchian_channel_width_1h", "body_size", "upper_shadow", "lower_shadow"), 0, None),
)
BINARY = (
    "pattern_doji", "pattern_engulfing", "pattern_hammer", "pattern_morning_star", "was_profitable_12h", "is_weekend",
    "asian_session", "european_session", "american_session", "profit_target_1pct", "profit_target_2pct", "volume_price_confirmation",
)
#: Columns whose size says nothing.
NO_SIZE = ("quote_volume", "obv_1h", "future_risk_adj_return_12h", "awesome_oscillator", "volume_price_trend")
#: Tolerances of recomputed columns; all others have 1e-6.
TOLERANCE = {
    "std_dev_returns_20": 0.01, "z_score_20": 0.05, "hurst_exponent": 0.1, "shannon_entropy": 0.2, "skewness_20": 0.5, "kurtosis_20": 1.0, "autocorr_1": 0.5,
    "body_size": 1e-8, "upper_shadow": 1e-8, "lower_shadow": 1e-8, "relative_close_position": 1e-8,
    "future_max_return_24h_pct": 1e-4, "future_max_drawdown_12h_pct": 1e-4, "future_risk_adj_return_12h": 1e-4,
}
#: A bar's time to the next, in minutes, beyond which there is a gap.
GAP_MINUTES = 66
#: Share of missing cells that is forgiven.
FORGIVEN = 0.05
#: Hours of the future that each label needs.
HORIZON = {
    "future_return_1h_pct": 1, "future_return_4h_pct": 4, "future_return_12h_pct": 12, "future_return_1d_pct": 24, "future_return_3d_pct": 72,
    "future_return_1w_pct": 168, "future_return_2w_pct": 336, "future_max_return_24h_pct": 24, "future_max_drawdown_12h_pct": 12,
}
