"""Readers and writers of packages."""
