"""Training-data operators: deduplication, packing, scoring, sharding, mixing, formatting."""
