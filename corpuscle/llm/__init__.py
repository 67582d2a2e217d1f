"""Operators for preparing training text: one module for each, and their queries.

Nothing outside this package imports it.
"""
