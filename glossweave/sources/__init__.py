"""Readers, writers and streams."""
