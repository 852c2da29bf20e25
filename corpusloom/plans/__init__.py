"""Composed pipelines and reports."""
