"""Training-data operators: deduplication, scoring, filtering and mixing of text corpora."""
