"""Operators on DataFrames: anchors, patterns, statistics, similarity, corpus building."""
