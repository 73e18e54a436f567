"""Readers and writers of the stores and batches."""
