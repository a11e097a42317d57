"""Training-data operators: dedup, extraction, scoring, mixing, packing, archives, search."""
