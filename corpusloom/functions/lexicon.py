"""Fields of dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_FREQUENCY = 1_000_000_000


def level(tags: Column) -> Column:
    """The least ``new-N``, else the least ``old-N``, else null."""

    def least(kind: str) -> Column:
        pattern = f"^{kind}-(\\d+)$"
        own = F.filter(tags, lambda t: F.trim(t).rlike(pattern))
        return F.array_min(F.transform(own, lambda t: F.regexp_extract(F.trim(t), pattern, 1).cast("int")))

    return F.coalesce(least("new"), least("old"))


def unique_join(items: Column, separator: str = "; ") -> Column:
    """Trimmed, non-blank, distinct items in order of appearance; null if there are none."""
    kept = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))


def frequency(raw: Column) -> Column:
    """A number, or a text of digits; anything else is null."""
    text = raw.cast("string")
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("int"))


def forms(entries: Column) -> dict[str, Column]:
    """Traditional spellings, pinyin and meanings over all forms of an entry."""
    return {
        "traditional": unique_join(F.transform(entries, lambda f: f["traditional"])),
        "pinyin": unique_join(F.transform(entries, lambda f: f["transcriptions"]["pinyin"])),
        "meanings": unique_join(F.flatten(F.transform(entries, lambda f: F.coalesce(f["meanings"], F.array().cast("array<string>"))))),
    }
