"""Operators from ticks to bars, labels, weights, features and statistics."""
