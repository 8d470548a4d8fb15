"""Training-data operators: extraction, near-duplicates, token ids, media, search, mixing, scoring, selection, lists."""
