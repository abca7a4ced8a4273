"""Structured Streaming form of the rating build."""
