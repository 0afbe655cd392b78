"""Training-data operators: tokenisation, search, deduplication, media, packing, archives, sharding, language."""
