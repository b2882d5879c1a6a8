"""Training-data operators: dedup, decontamination, PII, quality, mixing and the like."""
