"""Landed raw tables to items. Bodies are rows of a table, so parsing runs in parallel."""
