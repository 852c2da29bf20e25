"""Rewriting texts by a table of phrases and characters, such as traditional ones and their simplified forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lookup import lookup_table
from corpusloom.functions.tokenizers import trie_pattern

Rewriter = Callable[[Column], Column]


def rewriter(mapping: DataFrame, source: str = "source", target: str = "target") -> Rewriter:
    """Replaces, from left to right, the longest ``source`` at each place by its ``target``.

    So phrases go before the characters they are made of, and what was written isn't read again.  Of a source with several targets the least
    one counts; rows without a source or target are left out.  No rows at all are an error, since nothing would be rewritten.
    Null texts stay null.
    """
    key, to = F.col(source), F.col(target)
    rows = mapping.where(key.isNotNull() & (key != "") & to.isNotNull()).groupBy(key.alias("key")).agg(F.min(to).alias("to"))
    table = lookup_table(rows)
    # bounded as the table is
    pattern = trie_pattern((r["key"] for r in rows.select("key").collect()), any_start=True)
    if not pattern:
        raise ValueError("nothing to rewrite: the mapping is empty")

    def rewrite(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(f"(?s){pattern}|."), F.lit(0))
        written = F.array_join(F.transform(parts, lambda p: F.coalesce(table.get(p)["to"], p)), "")
        return F.when(text.rlike(pattern), written).otherwise(text)

    return rewrite


def any_script(text: Column) -> Column:
    """Rewrites nothing, for corpora whose script isn't to be checked."""
    return text


def is_unchanged(text: Column, rewrite: Rewriter) -> Column:
    """Whether rewriting leaves the text as it is."""
    return rewrite(text) == text
