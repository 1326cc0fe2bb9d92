"""Corpus analytics on Spark: DataFrame operators for building, checking and measuring text corpora."""
