"""Operators over data frames."""
