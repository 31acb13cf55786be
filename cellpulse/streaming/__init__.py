"""Structured Streaming use of the batch operators (usage sums over a file stream)."""
