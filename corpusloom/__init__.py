"""Corpus search, knowledge-graph analytics and change processing on Spark."""
