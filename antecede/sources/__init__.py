"""Readers and table contracts."""
