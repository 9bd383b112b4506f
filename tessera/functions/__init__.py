"""Types, literals and the five aggregates."""
