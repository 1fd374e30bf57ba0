"""Training-data operators: dedup, tokens, alignment, archives, PII, quality, packing, toxicity, clusters, licenses."""
