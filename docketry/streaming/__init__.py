"""Streaming of the case-record engine."""
