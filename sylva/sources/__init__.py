"""Readers and writers; formats are the ones Spark brings."""
