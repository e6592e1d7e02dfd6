"""Training-data operators: packing, filters, deduplication, tokenization, archives, search."""
