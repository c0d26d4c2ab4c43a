"""Streams of packages."""
