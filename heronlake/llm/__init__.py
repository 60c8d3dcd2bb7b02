"""Training-data operators: deduplication, privacy, tokens, packing, search."""
