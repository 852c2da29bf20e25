"""Corpus pattern analytics on Spark.

Sentences are cleaned, tokenised and turned into structural pattern keys around
anchor tokens; keys are aggregated to a global prior and to a personal state,
with reports on coverage, rarity and health.  Everything is an expression over
DataFrames.
"""
