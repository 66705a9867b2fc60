"""Continuous rebuilding of graphs."""
