"""Streams of cells and of log fragments."""
