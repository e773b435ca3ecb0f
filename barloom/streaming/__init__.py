"""Structured Streaming: bars with a watermark, idempotent upserts, exponential means as state."""
