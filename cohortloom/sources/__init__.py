"""Readers, writers and the fixed lookup tables."""
