"""Scores and ratios."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def mastery(count: Column) -> Column:
    return F.log1p(count)


def anchor_score(df_rate: Column, entropy: Column, tf: Column) -> Column:
    """Documents first, then variety of neighbours, then frequency."""
    return 2.0 * df_rate + 0.25 * entropy + 0.10 * F.log1p(tf)


def emerged(count: Column, sentences: Column, min_count: int = 3, min_sentences: int = 2) -> Column:
    return (count >= min_count) & (sentences >= min_sentences)


def ratio(part: Column, whole: Column) -> Column:
    """A share, 0 for nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * ratio(part, whole))


def thousands_text(number: Column) -> Column:
    return F.format_number(number, 0)


# What counts as yes in a meta table.
_TRUE = ("1", "true", "True", "yes", "YES")


def meta_int(meta: Mapping[str, str], name: str, default: int) -> int:
    """A whole number of the meta table, or the default if it has none."""
    text = (meta.get(name) or "").strip()
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else default


def meta_bool(meta: Mapping[str, str], name: str, default: bool = False) -> bool:
    text = meta.get(name)
    return default if text is None else text.strip() in _TRUE
