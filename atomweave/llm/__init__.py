"""Operators that prepare training corpora."""
