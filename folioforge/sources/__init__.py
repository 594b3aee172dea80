"""Readers of captured pages and listings, and the sinks."""
