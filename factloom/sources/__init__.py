"""Readers of stored tables, page scans and landing folders."""
