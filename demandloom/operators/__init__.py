"""DataFrame-in, DataFrame-out planning operators."""
