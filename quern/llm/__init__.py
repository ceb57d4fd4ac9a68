"""Operators that prepare and check text for language models."""
