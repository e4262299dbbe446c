"""Operators and queries for preparing training data of language models."""
