"""Prove that two tables agree, and compute the measures people argue about, as Spark jobs."""
