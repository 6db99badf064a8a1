"""Operators that change tables."""
