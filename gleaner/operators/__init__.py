"""Operators on findings and the scans that make them."""
