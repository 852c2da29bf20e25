"""Building the global prior from a corpus."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tokenizers import Tokenizer, words
from corpusloom.operators import anchor_pairs, statistics
from corpusloom.operators.patterns import DEFAULT_FAMILIES, extract
from corpusloom.sources import readers, sinks


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PatternConfig:
    """What is extracted from a sentence."""

    families: tuple[str, ...] = DEFAULT_FAMILIES
    max_ngram_n: int = 4
    max_gap: int = 20
    max_jump: int = 10

    def options(self) -> dict:
        return {"families": self.families, "max_ngram_n": self.max_ngram_n, "max_gap": self.max_gap, "max_jump": self.max_jump}


def tokenized(lines: DataFrame, tokenizer: Tokenizer = words, skip_empty: bool = True) -> DataFrame:
    """``sid, value, tokens`` of lines; sentences without tokens are skipped by the prior."""
    sid = F.col("line_no") if "line_no" in lines.columns else F.monotonically_increasing_id()
    rows = lines.select(sid.alias("sid"), "value", tokenizer(F.col("value")).alias("tokens"))
    return rows.where(F.size("tokens") > 0) if skip_empty else rows


@dataclass(frozen=True)
class Prior:
    """The tables ``pattern_global_stats`` and ``pattern_global_realizations`` of some lines, and what was counted on the way."""

    stats: DataFrame
    realizations: DataFrame
    seen: int
    kept: int


def prior_of(lines: DataFrame, anchors: Iterable[str], config: PatternConfig = PatternConfig(), tokenizer: Tokenizer = words, cap: int = 9999) -> Prior:
    """Counts and the first realizations of each key, written once; lines and sentences are counted in passing.

    Anchor pairs are counted as numbers and in a pass of their own, in which a task keeps ``cap`` realizations of a key; of
    the other families all pairs of keys and realizations are written.
    """
    spark, listed = lines.sparkSession, sorted(set(anchors))
    seen, kept = Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    plain = tokenized(lines, tokenizer)
    rows = tokenized(lines.observe(seen, n), tokenizer).observe(kept, n)
    others = tuple(f for f in config.families if f != "anch_pair")
    counts, texts = [], []

    def written(found: DataFrame, name: str) -> DataFrame:
        path = sinks.scratch(spark, name)
        found.write.parquet(path, compression="zstd")
        return spark.read.parquet(path)

    if len(others) < len(config.families):
        found = written(anchor_pairs.scan(rows, listed, config.max_gap, counts=True, first=cap if cap > 0 else None), "anchor-pairs")
        # told apart once, for both tables
        first = written(anchor_pairs.first_texts(found, max(cap, 0)), "anchor-pair-texts")
        counts.append(anchor_pairs.pattern_counts_of(found, first, listed))
        texts.append(anchor_pairs.named(first, listed))
        rows = plain
    if others or not counts:
        extracted = extract(rows, listed, realizations=cap > 0, **{**config.options(), "families": others})
        found = written(statistics.pattern_pairs(extracted, placed=True), "pairs")
        counts.append(statistics.counts_of_pairs(found))
        texts.append(statistics.first_realizations(found, max(cap, 0)))
    stats = statistics.with_diversity(statistics.prior_of_counts(reduce(DataFrame.unionByName, counts)), cap)
    if cap <= 0:
        stats = stats.withColumn("distinct_realization_count", F.lit(0).cast("long"))
    return Prior(stats, reduce(DataFrame.unionByName, texts), seen.get["n"], kept.get["n"])


def build(spark: SparkSession, lines: DataFrame, anchors: Iterable[str], store: str, config: PatternConfig = PatternConfig(), tokenizer: Tokenizer = words, cap: int = 9999, merge: bool = False, provenance: dict | None = None, mark: str | None = None) -> None:
    """Write (or, with ``merge``, add to) the prior below ``store``.

    A merge changes both tables at once; one that comes again with the ``mark`` of the last adds nothing.
    """
    began = time.time()
    listed = sorted(set(anchors))
    if not listed:
        raise ValueError("no anchors")
    sinks.create_prior(spark, store)
    found = prior_of(lines, listed, config, tokenizer, cap)
    columns = ["pattern_key", "family", "count_sentences", "count_occurrences", "distinct_realization_count", "p_global"]
    if merge:
        sinks.merge_prior(found.stats, found.realizations, store, cap, mark)
    else:
        sinks.replace(found.stats.select(*columns), store, "pattern_global_stats")
        sinks.replace(found.realizations, store, "pattern_global_realizations")
    total = readers.table(spark, store, "pattern_global_stats").agg(F.sum("count_sentences").alias("n")).first()["n"] or 0
    values = {
        "built_at_unix": int(began), "anchors_count": len(listed), "lines_seen": found.seen, "sentences_processed": found.kept, "total_df_sum": total, "max_realizations_per_pattern": cap, "build_seconds": round(time.time() - began, 2),
        "families": ",".join(config.families), "max_ngram_n": config.max_ngram_n, "max_gap": config.max_gap, "max_jump": config.max_jump, **(provenance or {}),
    }
    sinks.put_meta(spark, store, values)
    log.info("prior: %s lines seen, %s sentences, sum of sentence counts %s, %s s", f"{found.seen:,}", f"{found.kept:,}", f"{total:,}", values["build_seconds"])
