"""Report sections over the state and the prior, each a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.keys import is_valid, legacy_family_of
from corpusloom.functions.statistics import ratio
from corpusloom.operators.anchors import token_df, token_tf, zero_df
from corpusloom.operators.corpus import sample
from corpusloom.sources import readers, sinks

#: Bounds of the histogram's ranges; the last has none.
RANGES = ((1, 1), (2, 2), (3, 3), (4, 4), (5, 9), (10, 19), (20, 49), (50, 99), (100, 199), (200, 499), (500, 999), (1000, None))


def table_health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` of the given tables."""
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


def store_health(spark: SparkSession, store: str, expected: Mapping[str, str]) -> DataFrame:
    """``table_name, present, n_rows``: expected tables, missing ones without rows."""
    there = set(readers.tables(spark, store))
    rows = [(name, name in there, readers.table(spark, store, name).count() if name in there else None) for name in sorted(expected)]
    return spark.createDataFrame(rows, "table_name string, present boolean, n_rows long")


def selected_meta(meta: DataFrame, keys: list[str]) -> DataFrame:
    return meta.where(F.col("key").isin(keys)).orderBy("key")


def anchors_against_candidates(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """``token, is_candidate`` of every anchor; those that aren't break the contract."""
    known = candidates.select("token").distinct().withColumn("is_candidate", F.lit(True))
    return anchors.select("token").join(known, "token", "left").withColumn("is_candidate", F.coalesce("is_candidate", F.lit(False)))


def top_df_tokens(sentences: DataFrame, k: int = 25) -> DataFrame:
    """The tokens of most sentences with their frequency."""
    return token_df(sentences).join(token_tf(sentences), "token").orderBy(F.desc("df"), "token").limit(k)


def top_df_candidates(sentences: DataFrame, candidates: DataFrame, k: int = 25) -> DataFrame:
    """Candidates by sentences, 0 for those that don't occur."""
    joined = candidates.select("token").distinct().join(token_df(sentences), "token", "left")
    return joined.select("token", F.coalesce("df", F.lit(0)).cast("long").alias("df")).orderBy(F.desc("df"), "token").limit(k)


def spot_checks(sentences: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    return sample(sentences, k, seed, F.col("zh_text"))


def count_thresholds(stats: DataFrame, count: str, at: tuple[int, ...] = (1, 2, 3), from_: tuple[int, ...] = (5, 10, 100)) -> DataFrame:
    """One row: patterns, patterns of each count, patterns from each count on."""
    c = F.col(count)
    return stats.agg(F.count("*").alias("total"), *[F.count_if(c == n).alias(f"eq_{n}") for n in at], *[F.count_if(c >= n).alias(f"ge_{n}") for n in from_])


def count_histogram(stats: DataFrame, count: str) -> DataFrame:
    return stats.groupBy(F.col(count).alias("value")).agg(F.count("*").alias("n_patterns"))


def range_histogram(stats: DataFrame, count: str) -> DataFrame:
    """``low, label, n_patterns`` of every range, empty ones too."""
    spark = stats.sparkSession
    labels = [(low, str(low) if low == high else f"{low}-{high if high else '∞'}", high if high else 10**12) for low, high in RANGES]
    ranges = spark.createDataFrame(labels, "low long, label string, high long")
    bucket = F.lit(None).cast("long")
    for low, high in RANGES:
        bucket = F.when(F.col(count) >= low if high is None else F.col(count).between(low, high), low).otherwise(bucket)
    counted = stats.select(bucket.alias("low")).groupBy("low").agg(F.count("*").alias("n"))
    return ranges.join(counted, "low", "left").select("low", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_patterns"))


def family_breakdown(stats: DataFrame, top_k: int = 12) -> DataFrame:
    counted = stats.groupBy(legacy_family_of(F.col("pattern_key")).alias("family")).agg(F.count("*").alias("n_patterns"))
    return counted.orderBy(F.desc("n_patterns"), "family").limit(top_k)


#: Bits of a count that one pass of :func:`quantiles` tells.
_DIGIT = 12


def quantiles(stats: DataFrame, count: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: nearest-rank quantiles of a whole number from 0 on, 0 for an empty table.

    The counts' histogram is written once.  Then each pass tells the next digits of all quantiles by how many rows have which digit,
    a few thousand numbers however many different counts there are, so no task sorts them all.
    """
    spark = stats.sparkSession
    path = sinks.scratch(spark, "histogram")
    stats.groupBy(F.col(count).cast("long").alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL").write.parquet(path)
    histogram = spark.read.parquet(path)
    total = histogram.agg(F.sum("n").alias("n")).first()["n"] or 0
    left = {q: max(math.ceil(Decimal(str(q)) * total), 1) for q in at}
    found = dict.fromkeys(at, 0)
    for shift in range(60, -1, -_DIGIT) if total else ():
        prefix, digit = (F.shiftright("value", shift + _DIGIT) if shift < 60 else F.lit(0).cast("long")), F.shiftright("value", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        counted = histogram.select(prefix.alias("prefix"), digit.alias("digit"), "n").where(F.col("prefix").isin(sorted(set(found.values()))))
        rows = sorted(map(tuple, counted.groupBy("prefix", "digit").agg(F.sum("n").alias("n")).collect()))
        for q in at:
            own = [(d, n) for p, d, n in rows if p == found[q]]
            for d, n in own:
                if left[q] <= n:
                    found[q] = (found[q] << _DIGIT) + d
                    break
                left[q] -= n
    return spark.createDataFrame([tuple(found[q] for q in at)], ", ".join(f"p{round(q * 100)} long" for q in at))


def singletons(stats: DataFrame, count: str = "count_sentences") -> DataFrame:
    n = F.count_if(F.col(count) == 1)
    return stats.agg(F.count("*").alias("total"), n.alias("n_single"), ratio(n, F.count("*")).alias("share"))


def top_patterns(stats: DataFrame, k: int = 20, by: tuple[str, ...] = ("count_sentences",)) -> DataFrame:
    return stats.orderBy(*[F.desc(c) for c in by], "pattern_key").limit(k)


def lookup(stats: DataFrame, key: str, column: str = "pattern_key") -> DataFrame:
    """The rows of one key; the filter reaches the files' statistics."""
    return stats.where(F.col(column) == F.lit(key))


def page(rows: DataFrame, order: Sequence[str], offset: int, limit: int = 1) -> DataFrame:
    """``limit`` rows of an order from number ``offset`` (from 0) on; a minus sign before a column turns its order round."""
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return rows.orderBy(*by).offset(max(offset, 0)).limit(limit)


def top_emerged(personal: DataFrame, k: int = 20) -> DataFrame:
    return top_patterns(personal.where("emerged"), k, ("count_seen", "distinct_sentence_count"))


def with_realizations(top: DataFrame, realizations: DataFrame, k: int = 6, seed: int = 0) -> DataFrame:
    """Up to ``k`` realizations of each listed pattern, in the order of a seeded hash; one join."""
    order = Window.partitionBy("pattern_key").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "realization"), 256), "realization")
    joined = realizations.join(F.broadcast(top.select("pattern_key")), "pattern_key")
    return joined.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("pattern_key", "realization")


def vocabulary_health(vocab: DataFrame) -> DataFrame:
    """One row: words, words outside the lexicon, single characters, and their shares."""
    unknown, single = F.count_if(F.col("hsk_level").isNull()), F.count_if(F.char_length("word") == 1)
    n = F.count("*")
    return vocab.agg(n.alias("n_words"), unknown.alias("n_unknown"), single.alias("n_single"), ratio(unknown, n).alias("unknown_share"), ratio(single, n).alias("single_share"))


def top_vocabulary(vocab: DataFrame, k: int = 20) -> DataFrame:
    return vocab.orderBy(F.desc("count"), "word").limit(k)


def sentence_coverage(sentences: DataFrame) -> DataFrame:
    """One row: sentences with any pattern and with a skeleton; ``patterns`` are keys."""
    n = F.count("*")
    some = F.count_if(F.size("patterns") > 0)
    skeleton = F.count_if(F.exists("patterns", lambda k: legacy_family_of(k) == "skel"))
    return sentences.agg(n.alias("n_sentences"), some.alias("n_any"), skeleton.alias("n_skel"), ratio(some, n).alias("any_share"), ratio(skeleton, n).alias("skel_share"))


def anchors_without_sentences(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    return zero_df(anchors, sentences)


def key_validity(keys: DataFrame) -> DataFrame:
    valid = F.count_if(is_valid(F.col("pattern_key")))
    return keys.agg(F.count("*").alias("n_keys"), valid.alias("n_valid"), (F.count("*") - valid).alias("n_invalid"))
