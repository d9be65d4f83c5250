"""Readers, writers and views over the test tables."""
