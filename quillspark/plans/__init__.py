"""Whole queries: derived inputs, the registered queries and their SQL."""
