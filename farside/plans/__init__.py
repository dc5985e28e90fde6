"""Staging, queries and their SQL."""
