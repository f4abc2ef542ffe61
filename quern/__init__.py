"""Quern: measures tables of text, structures logs, and prepares text corpora on Spark."""

__version__ = "0.2.0"
