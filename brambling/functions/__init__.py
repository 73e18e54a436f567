"""Column functions on text, urls, bits and vectors."""
