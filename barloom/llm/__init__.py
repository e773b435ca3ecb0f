"""Training-data operators: deduplication, filters, tokenizing, mixing, archives and media."""
