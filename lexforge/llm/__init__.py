"""Training-data operators: secrets, packing, PII, near-dedup, quality, substrings, tokens, HTML, toxicity."""
