"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def beside(docs: DataFrame, wanted: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[pa.Array]]]:
    """``docs`` as ``row``, a struct of the ``keep`` columns, and those ``wanted`` that it lacks, and how to get the wanted ones of a batch.

    So a text that is carried along is sent to Python once.
    """
    lacking = [c for c in wanted if c not in keep]
    source = docs.select(F.struct(*keep).alias("row"), *[F.col(c).alias(f"own_{c}") for c in lacking])
    return source, lambda batch: [batch.column(f"own_{c}") if c in lacking else batch.column("row").field(c) for c in wanted]


def release_memory() -> None:
    """Give back what Arrow has freed; a worker outlives its task."""
    pa.default_memory_pool().release_unused()
