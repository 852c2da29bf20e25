"""Operators for preparing training data at scale.

Each module holds one operator with its own general interface; ``queries``
holds the thin queries that apply them to the driver tables.  Nothing outside
this subpackage imports it.
"""
