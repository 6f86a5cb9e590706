"""Incremental ingest: the cursor and the file stream."""
