"""Readers and writers for box tables."""
