"""Training-data operators: scoring, deduplication, scans, packing, mixing, quality."""
