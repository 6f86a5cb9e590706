"""Readers for landed snapshots, result pages and vectors."""
