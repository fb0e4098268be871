"""Readers and writers of record tables."""
