"""Passage-retrieval data work as Spark jobs: clean, enrich, sample, split, label, format, rank and score."""
