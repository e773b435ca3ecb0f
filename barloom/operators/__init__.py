"""Feature groups, joins and upserts over bars: each a function from DataFrame to DataFrame."""
