"""Training-data operators: search, tokenizers, near duplicates, personal data, chat format, mixing, toxicity."""
