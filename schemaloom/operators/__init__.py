"""Relational operators: joins, metrics, profiles, splits and set operations."""
