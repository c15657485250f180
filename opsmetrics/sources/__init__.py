"""Readers and declared schemas."""
