"""Readers and writers of external report formats."""
