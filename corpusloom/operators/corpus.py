"""Building corpora: cleaning, deduplicating, sampling and mixing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.rewriting import Rewriter, is_unchanged


def clean_news(lines: DataFrame, simplify: Rewriter, min_len: int = 6, max_len: int = 60) -> DataFrame:
    """Good sentences of news lines (``value``) that ``simplify`` leaves as they are."""
    cleaned = lines.select(T.clean_news(F.col("value")).alias("value"))
    return _good(cleaned, simplify, min_len, max_len)


def clean_wiki(texts: DataFrame, simplify: Rewriter, min_len: int = 6, max_len: int = 60) -> DataFrame:
    """Good sentences of wiki texts (``text``) that ``simplify`` leaves as they are."""
    sentences = texts.select(F.explode(T.split_sentences(F.coalesce("text", F.lit("")))).alias("value"))
    return _good(sentences.select(T.clean_wiki(F.col("value")).alias("value")), simplify, min_len, max_len)


def _good(lines: DataFrame, simplify: Rewriter, min_len: int, max_len: int) -> DataFrame:
    value = F.col("value")
    return lines.where((value != "") & T.good_length(value, min_len, max_len) & is_unchanged(value, simplify))


def distinct_lines(lines: DataFrame, order: str | None = None) -> DataFrame:
    """Each ``value`` once; the row with the least ``order`` if there is one."""
    if order is None:
        return lines.dropDuplicates(["value"])
    return lines.groupBy("value").agg(F.min(order).alias(order)).select(*lines.columns)


def sample(rows: DataFrame, k: int, seed: int, by: Column | None = None) -> DataFrame:
    """``k`` rows in the order of a seeded hash of ``by`` (all columns): uniform and repeatable.

    A top-k by hash needs one pass and no more than ``k`` rows of memory per task.
    """
    value = by if by is not None else F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)
    return rows.orderBy(digest, *rows.columns).limit(k)


def shuffle(rows: DataFrame, seed: int) -> DataFrame:
    """All rows in the order of a seeded hash."""
    value = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), value), 256), *rows.columns)


def mix(first: DataFrame, n_first: int, second: DataFrame, n_second: int, seed: int = 7) -> DataFrame:
    """Samples of two corpora of lines, together, shuffled, each line once."""
    both = sample(first.select("value"), n_first, seed).unionByName(sample(second.select("value"), n_second, seed))
    return shuffle(distinct_lines(both), seed)
