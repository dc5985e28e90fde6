"""Streams of day images."""
