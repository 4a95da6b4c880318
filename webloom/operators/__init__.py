"""Operators over DataFrames: retrieval, near-duplicates, recommendation, graphs, crawling."""
