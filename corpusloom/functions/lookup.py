"""Tables of a vocabulary's size that expressions look things up in, without a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a plan may hold; a vocabulary of any language has fewer.
MOST_ROWS = 1_000_000


@dataclass(frozen=True)
class LookupTable:
    """An array of buckets that a key's hash points into."""

    text: str
    buckets: int
    row: str

    def get(self, key: Column) -> Column:
        """The row of ``key`` as a struct, or null."""
        table = F.from_json(F.lit(self.text), f"array<array<{self.row}>>")
        bucket = F.get(table, F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["key"] == key), F.lit(0))


def lookup_table(rows: DataFrame) -> LookupTable:
    """A table of the ``rows``, whose column ``key`` is a text that doesn't repeat; too many rows are an error."""
    n = rows.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows; a lookup table holds {MOST_ROWS} at most")
    buckets = 1 << max(n, 1).bit_length()
    table: list[list[str]] = [[] for _ in range(buckets)]
    # bounded by the check above
    for bucket, text in rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"), F.to_json(F.struct(*rows.columns))).collect():
        table[bucket].append(text)
    return LookupTable(f"[{','.join(f'[{','.join(b)}]' for b in table)}]", buckets, rows.select(F.struct(*rows.columns).alias("row")).schema["row"].dataType.simpleString())
