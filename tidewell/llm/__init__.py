"""Training-data pipeline operators: filtering, deduplication, packing and scoring of text corpora."""
