"""Training-data operators: packing, formatting, filtering and deduplication."""
