"""Relational operators on panels keyed by (code, time)."""
