"""Incremental queries."""
