"""Training-data operators: decontamination, scoring, near-dedup, extraction, mixing."""
