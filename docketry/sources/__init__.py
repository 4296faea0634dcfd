"""Sources of the case-record engine."""
