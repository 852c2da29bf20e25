"""Whole inspections: the sections of each report in order, and their rendering as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions.statistics import meta_bool, meta_int, percent_text, thousands_text
from corpusloom.functions.tokenizers import Tokenizer, characters
from corpusloom.operators import similarity
from corpusloom.operators.anchors import anchor_list, top_tokens
from corpusloom.operators.corpus import sample
from corpusloom.operators.patterns import FAMILIES, extract
from corpusloom.plans import reports
from corpusloom.plans.bootstrap import FAMILY_KEYS
from corpusloom.plans.prior import PatternConfig
from corpusloom.sources import readers

Sections = dict[str, DataFrame]


def _meta(spark: SparkSession, store: str) -> DataFrame:
    return readers.table(spark, store, "meta", schemas.META)


def inspect_state(spark: SparkSession, store: str, candidates: DataFrame | None = None, recompute: bool = False, sample_size: int = 5, seed: int = 0, top: int = 20) -> Sections:
    """Integrity, anchors, spot checks, pattern and vocabulary health of a personal state."""
    sentences = readers.table(spark, store, "sentences", schemas.SENTENCES)
    tokens = sentences.select(F.col("tokens_word").alias("tokens"))
    personal = readers.table(spark, store, "pattern_personal_stats", schemas.PATTERN_PERSONAL_STATS)
    vocab = readers.table(spark, store, "vocab_stats", schemas.VOCAB_STATS)
    anchors = readers.anchors_or_meta(spark, None, _meta(spark, store))
    emerged = reports.top_emerged(personal, top)
    out: Sections = {"tables": reports.store_health(spark, store, schemas.STATE_TABLES), "meta": _meta(spark, store).orderBy("key"), "selected meta": reports.selected_meta(_meta(spark, store), SELECTED)}
    if candidates is not None:
        out["anchors against candidates"] = reports.anchors_against_candidates(anchors, candidates)
        out["candidates by sentences"] = reports.top_df_candidates(tokens, candidates)
    out["tokens by sentences"] = reports.top_df_tokens(tokens)
    if recompute:
        n = anchors.count()
        for method in ("df", "tf"):
            again = top_tokens(tokens, n, method, 4, candidates)
            out[f"anchors recomputed by {method}"] = similarity.list_overlap(anchors, again)
    out["sentences"] = reports.spot_checks(sentences.select("id", "zh_text", "tokens_word", "skeleton"), sample_size, seed)
    out["pattern counts"] = reports.count_thresholds(personal, "count_seen", (1, 2), (5,))
    out["pattern histogram"] = reports.count_histogram(personal, "count_seen").orderBy("value")
    out["emerged patterns"] = emerged
    out["their realizations"] = reports.with_realizations(emerged, readers.table(spark, store, "pattern_personal_realizations", schemas.PATTERN_PERSONAL_REALIZATIONS), seed=seed)
    out["vocabulary"] = reports.vocabulary_health(vocab)
    out["frequent words"] = reports.top_vocabulary(vocab, top)
    stored = readers.meta(spark, f"{store.rstrip('/')}/meta")
    if listed := anchor_list(anchors):
        out["length robustness"] = length_robustness(fixed_pairs(spark), listed, _stored_config(stored))
    return out


#: The sentence pairs of the length report.
LENGTH_PAIRS = [("我把它扔掉", "我把你昨天用的杯子扔掉了"), ("他在学校学习", "他今天在学校认真地学习了"), ("我给你打电话", "我昨天晚上给你打了一个电话")]


def fixed_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *pair) for i, pair in enumerate(LENGTH_PAIRS)], "pair_id long, short string, long string")


def length_robustness(pairs: DataFrame, anchors: list[str], config: PatternConfig = PatternConfig(), tokenizer: Tokenizer = characters) -> DataFrame:
    """Per pair of a short sentence and a longer one (``pair_id, short, long``): how many pattern keys they share, and their similarity."""

    def keyed(rows: DataFrame, text: str, name: str) -> DataFrame:
        found = extract(rows.withColumn("tokens", tokenizer(F.col(text))), anchors, realizations=False, **config.options())
        return found.withColumn(name, F.array_distinct(F.transform("patterns", lambda p: p["pattern_key"]))).drop("tokens", "patterns")

    sets = keyed(keyed(pairs, "short", "a"), "long", "b")
    shared = F.size(F.array_intersect("a", "b"))
    return sets.select("pair_id", "short", "long", shared.alias("shared"), (F.size("a") + F.size("b") - shared).alias("either"), similarity.jaccard(F.col("a"), F.col("b")).alias("similarity"))


def _stored_config(meta: dict[str, str]) -> PatternConfig:
    """What a state says its patterns were extracted with."""
    usual = PatternConfig()
    families = tuple(f for f in FAMILIES if meta_bool(meta, FAMILY_KEYS[f], f in usual.families))
    return PatternConfig(families, meta_int(meta, "max_ngram_n", usual.max_ngram_n), meta_int(meta, "span_max_gap", usual.max_gap), meta_int(meta, "skip_max_jump", usual.max_jump))


#: The settings that a state's report names.
SELECTED = [
    "schema_version", "bootstrapped_at", "anchors_source", "global_anchors_path", "global_candidates_count", "anchors_top_k", "anchor_method", "anchor_max_token_len", "anchors_count",
    "hsk_db_path", "hsk_table", "hsk_max_level", "include_level7", "max_ngram_n", *FAMILY_KEYS.values(), "span_max_gap", "skip_max_jump", "pattern_min_count_seen", "pattern_min_distinct_sentences",
]


def inspect_prior(spark: SparkSession, store: str, anchors: DataFrame | None = None, with_samples: bool = False, seed: int = 0, top: int = 20) -> Sections:
    """Tables, families, distribution and top patterns of a prior, under old or new names."""
    name = readers.first_table(spark, store, "pattern_global_stats", "global_pattern_stats", "pattern_stats") or "pattern_global_stats"
    stats = readers.table(spark, store, name, schemas.PATTERN_GLOBAL_STATS)
    best = reports.top_patterns(stats, top)
    out: Sections = {
        "tables": reports.store_health(spark, store, schemas.PRIOR_TABLES),
        "meta": _meta(spark, store).orderBy("key"),
        "families": reports.family_breakdown(stats),
        "counts": reports.count_thresholds(stats, "count_sentences"),
        "ranges": reports.range_histogram(stats, "count_sentences").orderBy("low"),
        "top patterns": best,
    }
    if with_samples:
        out["realizations"] = reports.with_realizations(best.limit(12), readers.table(spark, store, "pattern_global_realizations", schemas.PATTERN_GLOBAL_REALIZATIONS), seed=seed)
    if anchors is not None:
        out["anchor presence"] = similarity.anchor_presence(anchors, reports.top_patterns(stats, 200))
    return out


def inspect_pipeline(spark: SparkSession, state: str, prior: str, sample_size: int = 200, seed: int = 0) -> Sections:
    """Both stores together: health, distribution, coverage and keys."""
    stats = readers.table(spark, prior, "pattern_global_stats", schemas.PATTERN_GLOBAL_STATS)
    personal = readers.table(spark, state, "pattern_personal_stats", schemas.PATTERN_PERSONAL_STATS)
    sentences = readers.table(spark, state, "sentences", schemas.SENTENCES)
    some = sample(sentences.select("id", "zh_text", "patterns", F.col("tokens_word").alias("tokens")), sample_size, seed, F.col("zh_text"))
    anchors = readers.anchors_or_meta(spark, None, _meta(spark, state))
    return {
        "prior tables": reports.store_health(spark, prior, schemas.PRIOR_TABLES),
        "state tables": reports.store_health(spark, state, schemas.STATE_TABLES),
        "singletons": reports.singletons(stats),
        "quantiles": reports.quantiles(stats, "count_sentences"),
        "top patterns": reports.top_patterns(stats),
        "coverage": similarity.coverage_mass(personal, stats),
        "sentence coverage": reports.sentence_coverage(some),
        "anchors by sentences": reports.top_df_candidates(some, anchors),
        "anchors without sentences": reports.anchors_without_sentences(anchors, some),
        "keys of the prior": reports.key_validity(stats),
        "keys of the state": reports.key_validity(personal),
    }


def flat(sections: Sections, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """``section, key, field, value`` of all sections as one table, whose rows are told apart by the ``keys`` of each section.

    Values are texts: fractions in whole millionths, lists joined by spaces.
    """
    parts = []
    for title, rows in sections.items():
        by = list(keys.get(title, ()))
        fields = []
        for f in rows.schema:
            if f.name not in by:
                kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
                value = F.rint(c * 1_000_000).cast("long") if kind == "double" else F.array_join(c, " ") if kind == "array" else c
                fields.append(F.struct(F.lit(f.name).alias("field"), value.cast("string").alias("value")))
        key = F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in by]) if by else F.lit("")
        none = F.struct(F.lit("there").alias("field"), F.lit("true").alias("value"))
        parts.append(rows.select(F.lit(title).alias("section"), key.alias("key"), F.inline(F.array(*(fields or [none])))))
    return reduce(DataFrame.unionByName, parts)


#: What tells the rows of each section apart.
KEYS = {
    "tables": ["table_name"], "prior tables": ["table_name"], "state tables": ["table_name"], "meta": ["key"], "selected meta": ["key"], "families": ["family"], "ranges": ["low"], "top patterns": ["pattern_key"],
    "realizations": ["pattern_key", "realization"], "anchor presence": ["token"], "anchors by sentences": ["token"], "anchors without sentences": ["token"], "anchors against candidates": ["token"], "candidates by sentences": ["token"],
    "tokens by sentences": ["token"], "sentences": ["zh_text"], "pattern histogram": ["value"], "emerged patterns": ["pattern_key"], "their realizations": ["pattern_key", "realization"], "frequent words": ["word"], "length robustness": ["pair_id"], "runs": ["id"],
}


def printed(rows: DataFrame) -> DataFrame:
    """``rows`` as people read them: counts with thousands marked, shares in per cent."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "long":
            return thousands_text(c)
        return percent_text(c, F.lit(1.0)) if kind == "double" and name.endswith(("share", "mass")) else c

    return rows.select(*[shown(f.name, f.dataType.typeName()).alias(f.name) for f in rows.schema])


def render(sections: Sections, rows: int = 25) -> str:
    """The first rows of every section as text, under its title."""
    out = []
    for title, df in sections.items():
        table = [df.columns, *([str(x) for x in r] for r in printed(df.limit(rows)).collect())]
        out += [f"=== {title} ===", *(" | ".join(line) for line in table)]
    return "\n".join(out)
