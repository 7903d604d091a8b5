"""Structured Streaming jobs; each has a batch counterpart it must equal."""
