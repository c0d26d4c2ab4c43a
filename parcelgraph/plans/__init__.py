"""Logical tables of packages."""
