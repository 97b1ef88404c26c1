"""Incremental loading of boxes."""
