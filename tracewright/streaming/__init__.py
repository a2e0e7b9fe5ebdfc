"""Structured Streaming forms of the keyed accumulators; each equals its batch form on the same input."""
