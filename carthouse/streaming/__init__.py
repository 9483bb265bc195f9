"""Structured Streaming forms of the read sides and the purchase feed."""
