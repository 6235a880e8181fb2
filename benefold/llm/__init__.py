"""Training-data operators: near-duplicates, mixing, archives, fingerprints, scans, extraction, tokens."""
