"""Column functions: JSON literals, key=value pairs, units, vocabulary."""
