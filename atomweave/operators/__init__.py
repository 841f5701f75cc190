"""Relational and particle operators."""
