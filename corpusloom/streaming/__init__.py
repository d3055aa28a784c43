"""Structured Streaming jobs, each with the batch rule it follows."""
