"""Vocabulary-record analytics on Spark: cleaning, matching, survivorship, quality and review scheduling."""
