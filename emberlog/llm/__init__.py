"""Training-data operators: mixing, deduplication, filtering, archives and scoring of documents."""
