"""Training-data operators: decontamination, formatting, PII, quality, dedup, packing."""
