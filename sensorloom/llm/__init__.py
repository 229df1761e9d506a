"""Operators for preparing training text at corpus scale; nothing outside this package imports it."""
