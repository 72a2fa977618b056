"""Readers, writers and table replacement."""
