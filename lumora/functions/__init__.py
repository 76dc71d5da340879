"""Part of the lumora engine."""
