"""Window specifications, guards and scalar helpers on columns."""
