"""Readers, writers and keyed merges for the stored tables."""
