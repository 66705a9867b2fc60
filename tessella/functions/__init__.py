"""Scalar building blocks: interval sets, text, calendars."""
