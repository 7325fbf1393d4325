"""Training-data operators: counting, filtering, scoring and deduplicating documents."""
