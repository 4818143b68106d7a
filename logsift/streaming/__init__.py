"""Streams of log lines: labels by a stored model, counts by address and user."""
