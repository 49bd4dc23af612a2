"""Operators on DataFrames: sections, relations, retrieval, expansion, evaluation, summaries."""
