"""Readers of logs and labels, writer of results."""
