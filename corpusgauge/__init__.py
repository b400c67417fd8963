"""Spark-first scoring, comparison and curation of language-model data."""
