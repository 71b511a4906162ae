"""Training-data operators: filtering, deduplication, extraction, mixing, packing, archives."""
