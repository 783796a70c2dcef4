"""Streams of rows."""
