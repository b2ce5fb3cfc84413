"""Whole queries: adapters from stored tables to canonical relations, and the query catalogue."""
