"""Composite answers built from several operators."""
