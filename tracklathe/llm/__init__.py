"""Operators for building training data from recordings and their documents."""
