"""Loads all modules that register queries."""

from . import q_records, q_search, q_tables, q_text  # noqa: F401
