"""Structured Streaming forms of the feed, pairing, suppression and conversion work."""
