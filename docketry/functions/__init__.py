"""Functions of the case-record engine."""
