"""Part of the lexmill engine."""
