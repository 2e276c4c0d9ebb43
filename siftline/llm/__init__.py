"""Training-data operators: deduplication, filtering, scoring, mixing, packing and token files."""
