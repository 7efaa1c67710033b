"""Operators for preparing text to train language models; nothing else in the library imports this package."""
