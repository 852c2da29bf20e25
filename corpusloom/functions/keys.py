"""Canonical pattern keys: ``family|a=<anchors>|p=<parameters>``.

Backslash, bar, comma and equals sign are escaped inside components, so a key
can be told apart from any other; parameters are in order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "<X>"


def escape(component: Column) -> Column:
    for mark in ("\\", "|", ",", "="):
        component = F.replace(component, F.lit(mark), F.lit("\\" + mark))
    return component


def key(family: str | Column, anchors: Column, **params: Column) -> Column:
    """A key from an array of anchors and string parameters."""
    if isinstance(family, str):
        if not family or "|" in family:
            raise ValueError(f"not a family: {family!r}")
        family = F.lit(family)
    parts = [F.concat(escape(F.lit(name)), F.lit("="), escape(value)) for name, value in sorted(params.items())]
    return F.concat(family, F.lit("|a="), F.array_join(F.transform(anchors, escape), ","), F.lit("|p="), F.concat_ws(",", *parts))


def key_of(family: Column, anchors: Column, params: Column) -> Column:
    """A key from an array of anchors and a map of parameters; blank names are left out."""
    named = F.transform(F.map_entries(params), lambda e: F.struct(F.trim(e["key"]).alias("k"), e["value"].alias("v")))
    ordered = F.array_sort(F.filter(named, lambda e: e["k"] != ""))
    written = F.array_join(F.transform(ordered, lambda e: F.concat(escape(e["k"]), F.lit("="), escape(e["v"]))), ",")
    return F.concat(family, F.lit("|a="), F.array_join(F.transform(anchors, escape), ","), F.lit("|p="), written)


def gap_bucket(gap: Column) -> Column:
    return F.when(gap <= 0, "0").when(gap == 1, "1").when(gap <= 3, "2-3").when(gap <= 7, "4-7").otherwise("8+")


def family_of(pattern_key: Column) -> Column:
    """The text before the first bar; ``unknown`` for null and empty keys."""
    blank = pattern_key.isNull() | (pattern_key == "")
    return F.when(blank, "unknown").otherwise(F.substring_index(pattern_key, "|", 1))


def legacy_family_of(pattern_key: Column) -> Column:
    """As :func:`family_of`, also for keys of the older form ``family:...``."""
    return F.when(F.instr(pattern_key, "|") > 0, F.substring_index(pattern_key, "|", 1)).when(F.instr(pattern_key, ":") > 0, F.substring_index(pattern_key, ":", 1)).otherwise("unknown")


def is_valid(pattern_key: Column) -> Column:
    return F.coalesce((pattern_key != "") & pattern_key.contains("|a=") & pattern_key.contains("|p="), F.lit(False))
