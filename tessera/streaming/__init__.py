"""Statements that arrive as a stream."""
