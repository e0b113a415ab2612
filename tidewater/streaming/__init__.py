"""Structured Streaming versions of operators that follow a growing collection."""
