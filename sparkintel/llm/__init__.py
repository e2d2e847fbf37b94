"""Operators that prepare language-model training text."""
