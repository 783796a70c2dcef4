"""Training-data operators: deduplication, language, quality, tokens, packing, fingerprints."""
