"""Operators for training data: percentiles, token ids, leaked evaluation texts, personal data."""
