"""Incremental versions of stages."""
