"""Batch jobs over large multilingual text corpora, on Spark."""
