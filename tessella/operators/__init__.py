"""Operators over graphs of assertions."""
