"""Training-data operators (URL filter, secrets, BPE, fingerprints, quality, near-duplicates, packing, chat)."""
