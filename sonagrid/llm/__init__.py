"""Operators that prepare text and media for training language models."""
