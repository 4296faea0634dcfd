"""Operators of the case-record engine."""
