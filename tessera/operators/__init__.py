"""Operators on whole frames."""
