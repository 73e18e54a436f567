"""Relational, retrieval and crawl operators: DataFrame in, DataFrame out."""
