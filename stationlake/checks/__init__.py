"""Checks of the library."""
