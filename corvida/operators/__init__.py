"""Relational operators: identity graph, split, threshold, metrics, resampling."""
