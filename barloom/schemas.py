"""Schemas of raw tables and of validation results, as DDL."""

#: Hourly bars; (pair, timestamp_utc) is the key.
CANDLES = "pair string, timestamp_utc timestamp, open double, high double, low double, close double, volume double, quote_volume double"
CANDLES_15M = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double, volume_ccy double, volume_quote double, confirmed boolean"
PRICE_CANDLES = "timestamp timestamp, symbol string, open double, high double, low double, close double, confirmed boolean"
FUNDING = "funding_time timestamp, symbol string, funding_rate double, realized_rate double, formula_type string, method string"
PREMIUM = "timestamp timestamp, symbol string, premium double"
TRADES = "pair string, trade_id string, price double, quantity double, side string, timestamp_utc timestamp"
ISSUES = "pair string, validator string, issue_type string, column string, issues bigint, candles bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
