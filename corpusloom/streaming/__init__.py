"""Incremental building of the prior."""
