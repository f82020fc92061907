"""Structured Streaming forms of the pixel sampler and the run log."""
