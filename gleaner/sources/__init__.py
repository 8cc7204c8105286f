"""Readers and table preparation."""
