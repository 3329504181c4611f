"""Training-data operators: mixing, language ID, deduplication, sharding, tokenizing, search, extraction, formatting."""
