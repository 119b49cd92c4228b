"""Operators for training data: history de-duplication, representatives, term counts, tokens, leaks and cut texts."""
