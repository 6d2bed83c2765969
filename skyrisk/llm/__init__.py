"""Training-data operators: deduplication, decontamination, language ID, packing, sharding, search."""
