"""Operators for training-data pipelines: fingerprints, filters, duplicates, tokens, pseudonyms."""
