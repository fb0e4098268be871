"""Helpers that shape plans: shared scratch tables and table access."""
