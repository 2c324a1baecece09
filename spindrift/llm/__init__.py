"""Training-data operators: deduplication, scoring, search, mixing and tokenising."""
