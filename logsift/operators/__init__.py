"""DataFrame-in, DataFrame-out operators keyed by line number."""
