"""Structured Streaming versions of the window operators."""
