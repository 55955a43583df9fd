"""Training-data operators: dedup, packing, scoring, mixing and formatting over whole corpora."""
