"""Training-data operators: filters, scans, near-duplicates, models, tokens and shards over text tables."""
