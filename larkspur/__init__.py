"""Spark jobs for a file catalogue: inventory, versions, queue, text, search and fleet reports."""
