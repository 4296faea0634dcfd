"""Plans of the case-record engine."""
