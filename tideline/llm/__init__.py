"""Training-corpus operators: dedup, quality, extraction, tokens, packing. Nothing outside imports this."""
