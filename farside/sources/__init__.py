"""Readers, writers and fixtures."""
