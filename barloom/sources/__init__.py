"""Scans and parsers: bars from events, raw exchange messages, paged recordings."""
