"""Training-data operators: deduplication, packing, mixing, language, personal data, secrets."""
