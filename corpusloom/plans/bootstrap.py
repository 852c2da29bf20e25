"""The personal bootstrap: known sentences to state tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import normalize
from corpusloom.functions.tokenizers import Tokenizer, characters, words
from corpusloom.operators import anchor_pairs, lexical, statistics
from corpusloom.operators.anchors import anchor_list, top_tokens
from corpusloom.operators.patterns import explode, extract, membership, skeleton_text
from corpusloom.plans.prior import PatternConfig
from corpusloom.sources import readers, sinks


# Keys of the meta table that tell which families were extracted.
FAMILY_KEYS = {
    "tok_ng": "add_tok_ngrams",
    "anch_win": "add_anchor_windows",
    "skel": "add_skeleton",
    "cskel": "add_compressed_skeleton",
    "anch_pair": "add_anchor_pairs",
    "a_skip2": "add_anchor_skip2",
    "a_skip3": "add_anchor_skip3",
    "anch_seq": "add_anchor_sequence",
    "anch_span": "add_anchor_spans",
    "span_sig": "add_span_signatures",
}
#: Names the extraction that a state was made with.
EXTRACTOR_VERSION = "corpusloom_patterns_1"


@dataclass(frozen=True)
class BootstrapConfig:
    """Parameters of a bootstrap.

    With ``activate_locally`` the anchors are the most frequent candidates of the known
    sentences; without, all candidates are anchors, as the prior has them.
    """

    source: str = "bootstrap"
    anchors_top_k: int = 150
    anchor_method: str = "df"
    anchor_max_token_len: int = 4
    activate_locally: bool = True
    max_level: int = 6
    include_level7: bool = False
    min_count: int = 3
    min_sentences: int = 2
    patterns: PatternConfig = field(default_factory=PatternConfig)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def tokenized(known: DataFrame, tokenizer: Tokenizer = words) -> DataFrame:
    """``sid, value, tokens`` of known sentences (``value``)."""
    return known.select(F.monotonically_increasing_id().alias("sid"), "value", tokenizer(F.col("value")).alias("tokens"))


def first_lines(sentences: DataFrame) -> DataFrame:
    """``sid, zh_text, value`` of the first sentence of each normalised text; the value is carried only where it differs."""
    named = sentences.select("sid", normalize(F.col("value")).alias("zh_text"), "value")
    row = F.struct("sid", F.when(F.col("value") != F.col("zh_text"), F.col("value")).alias("own"))
    first = named.select("zh_text", row.alias("row")).groupBy("zh_text").agg(F.min("row").alias("row"))
    return first.select("row.sid", "zh_text", F.coalesce("row.own", "zh_text").alias("value"))


def _with_keys(sentences: DataFrame, anchors: list[str], config: PatternConfig) -> DataFrame:
    """Sentences with ``patterns``, the keys of all their patterns in order."""
    if config.families == ("anch_pair",):
        return anchor_pairs.with_keys(sentences, anchors, config.max_gap)
    return extract(sentences, anchors, realizations=False, **config.options()).withColumn("patterns", F.transform("patterns", lambda p: p["pattern_key"]))


def _counts(sentences: DataFrame, anchors: list[str], config: PatternConfig) -> DataFrame:
    """Counts of each key; anchor pairs are counted as numbers."""
    others = tuple(f for f in config.families if f != "anch_pair")
    counts = [anchor_pairs.key_counts(sentences, anchors, config.max_gap)] if len(others) < len(config.families) else []
    if others or not counts:
        counts.append(statistics.key_counts(extract(sentences, anchors, realizations=False, **{**config.options(), "families": others})))
    return reduce(DataFrame.unionByName, counts)


def _texts(sentences: DataFrame, anchors: list[str], config: PatternConfig) -> DataFrame:
    """Distinct realizations of each key."""
    others = tuple(f for f in config.families if f != "anch_pair")
    texts = [anchor_pairs.realizations(sentences, anchors, config.max_gap)] if len(others) < len(config.families) else []
    if others or not texts:
        texts.append(statistics.realizations(explode(extract(sentences, anchors, **{**config.options(), "families": others}))))
    return reduce(DataFrame.unionByName, texts)


def _unmet(sentences: DataFrame, store: str, config_hash: str, anchors_hash: str) -> DataFrame | None:
    """Sentences whose realizations the store may lack; None if it lacks none.

    It has those of all sentences that runs with the same anchors and parameters stored, as a run is written last and
    sentences after realizations.  Sentences are alike if their tokens are, told by two 64-bit hashes.
    """
    spark = sentences.sparkSession
    alike = (F.col("config_hash") == config_hash) & (F.col("anchors_hash") == anchors_hash)
    # a time of other runs, too, doesn't tell whose a sentence is
    times = readers.table(spark, store, "runs").groupBy("created_at").agg(F.min(F.coalesce(alike, F.lit(False))).alias("alike")).where("alike").select("created_at")
    if times.isEmpty():
        return sentences
    told = lambda tokens: [F.xxhash64(F.lit(seed), tokens).alias(f"h{seed}") for seed in (1, 2)]
    stored = readers.table(spark, store, "sentences").join(times, "created_at", "left_semi").select(*told("tokens_word"))
    path = sinks.scratch(spark, "unmet")
    sentences.select("sid", "tokens", *told("tokens")).join(stored, ["h1", "h2"], "left_anti").select("sid", "tokens").write.parquet(path, compression="zstd")
    unmet = spark.read.parquet(path)
    return None if unmet.isEmpty() else unmet


def bootstrap(spark: SparkSession, known: DataFrame, lexicon: DataFrame, store: str, candidates: DataFrame | None = None, config: BootstrapConfig = BootstrapConfig(), tokenizer: Tokenizer = words, now: datetime | None = None, provenance: Mapping[str, object] | None = None) -> None:
    """Write the state of ``known`` sentences below ``store``.

    ``provenance`` adds to the meta table where things came from, such as ``global_anchors_path`` and ``hsk_db_path``.
    """
    now = now or datetime.now(timezone.utc)
    at = F.lit(now.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
    sinks.create_state(spark, store)
    entries = statistics.best_entries(lexicon, config.max_level, config.include_level7)
    # a vocabulary's words: what the lexical tokeniser is compiled from
    vocabulary = [r["simplified"] for r in entries.select("simplified").collect()]
    path = sinks.scratch(spark, "tokenized")
    tokenized(known, tokenizer).write.mode("overwrite").parquet(path, compression="zstd")
    sentences = spark.read.parquet(path)
    if candidates is not None and not config.activate_locally:
        anchors = anchor_list(candidates)
    else:
        anchors = anchor_list(top_tokens(sentences, config.anchors_top_k, config.anchor_method, config.anchor_max_token_len, candidates))
    listed = json.dumps(anchors, ensure_ascii=False)
    anchors_hash = hashlib.sha256(listed.encode()).hexdigest()
    is_anchor, text, runs = membership(anchors), F.col("value"), lexical.run_lexicon(spark, vocabulary)
    unmet = _unmet(sentences, store, config.hash(), anchors_hash)
    if unmet is not None:
        texts = sinks.missing(_texts(unmet, anchors, config.patterns), store, "pattern_personal_realizations", ["pattern_key", "realization"])
        # in order, as texts that begin alike are stored in little room; those of pairs come so
        ordered = texts if config.patterns.families == ("anch_pair",) else texts.sortWithinPartitions("pattern_key", "realization")
        sinks.append(ordered, store, "pattern_personal_realizations")
    # texts are told apart before anything is made of them
    new = sinks.missing(first_lines(sentences).withColumn("source", F.lit(config.source)), store, "sentences", ["zh_text", "source"])
    made_of = lexical.with_tokens(new.withColumn("tokens", tokenizer(text)), runs, text, "tokens_hsk")
    rows = _with_keys(made_of, anchors, config.patterns).select(
        F.col("sid").alias("id"), "zh_text", F.col("tokens").alias("tokens_word"), "tokens_hsk", characters(text).alias("tokens_char"), "patterns",
        skeleton_text(F.col("tokens"), is_anchor).alias("skeleton"), "source", at.alias("created_at"),
    )
    sinks.append(rows, store, "sentences")
    sinks.upsert(statistics.vocabulary_of_counts(lexical.word_counts(sentences, runs, text), entries, at), store, "vocab_stats", "word")
    own = _counts(sentences, anchors, config.patterns).withColumnsRenamed({"count_occurrences": "own_occurrences", "count_sentences": "own_sentences"})
    sinks.upsert(statistics.personal_of_counts(own, at, config.min_count, config.min_sentences), store, "pattern_personal_stats", "pattern_key")
    flat = {k: v for k, v in asdict(config).items() if k != "patterns"} | asdict(config.patterns) | {"families": ",".join(config.patterns.families)}
    # the same under the keys that tools for such states look for
    flat |= {key: int(family in config.patterns.families) for family, key in FAMILY_KEYS.items()} | {
        "hsk_max_level": config.max_level,
        "include_level7": int(config.include_level7),
        "span_max_gap": config.patterns.max_gap,
        "skip_max_jump": config.patterns.max_jump,
        "pattern_min_count_seen": config.min_count,
        "pattern_min_distinct_sentences": config.min_sentences,
    }
    source = f"global_candidates+local_{config.anchor_method}" if candidates is not None else f"local_{config.anchor_method}"
    made = {"anchors_source": source, "extractor_version": EXTRACTOR_VERSION, **{k: v for k, v in (provenance or {}).items() if v is not None}}
    if candidates is not None:
        made["global_candidates_count"] = candidates.select("token").distinct().count()
    sinks.put_meta(spark, store, flat | made | {"anchors_count": len(anchors), "anchors_json": listed, "anchors_hash": anchors_hash, "config_hash": config.hash(), "bootstrapped_at": now.isoformat()})
    run_id = spark.read.parquet(f"{store}/runs").count() + 1
    run = spark.createDataFrame([(run_id, "bootstrap", config.hash(), anchors_hash, None)], "id long, kind string, config_hash string, anchors_hash string, notes string")
    sinks.append(run.select("id", "kind", at.alias("created_at"), "config_hash", "anchors_hash", "notes"), store, "runs")


