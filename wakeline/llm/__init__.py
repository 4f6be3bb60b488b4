"""Training-data operators: tokens, packing, deduplication, cleaning, search."""
