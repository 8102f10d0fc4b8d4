"""Operators for large-scale text-corpus preparation; nothing else in the library imports this subpackage."""
