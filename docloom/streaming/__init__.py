"""Structured Streaming jobs. Each function starts one query and returns it."""
