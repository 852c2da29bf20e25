"""Pattern and vocabulary statistics: the personal state and the global prior.

A sentence sends its keys twice, all of them for occurrences and the distinct
ones for sentence counts, so both come from one aggregation by key with
map-side sums: only keys are shuffled, never (key, sentence) pairs, and hot
keys shrink before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.keys import family_of
from corpusloom.functions.statistics import emerged, mastery

NO_CAP = 0


def key_counts(sentences: DataFrame, own: Column | None = None) -> DataFrame:
    """``pattern_key, count_occurrences, count_sentences`` of sentences with ``patterns``.

    With ``own``, which tells some of the sentences, also ``own_occurrences`` and ``own_sentences``, in the same pass.
    """
    keys = F.transform("patterns", lambda p: p["pattern_key"])
    each = lambda ks, o, s: F.transform(ks, lambda k: F.struct(k.alias("pattern_key"), F.lit(o).alias("o"), F.lit(s).alias("s")))
    both = F.concat(each(keys, 1, 0), each(F.array_distinct(keys), 0, 1))
    sums = [F.sum("o").alias("count_occurrences"), F.sum("s").alias("count_sentences")]
    if own is None:
        return sentences.select(F.inline(both)).groupBy("pattern_key").agg(*sums)
    sums += [F.sum(F.when(F.col("own"), F.col(c)).otherwise(0)).alias(name) for c, name in (("o", "own_occurrences"), ("s", "own_sentences"))]
    return sentences.select(F.coalesce(own, F.lit(False)).alias("own"), F.inline(both)).groupBy("pattern_key").agg(*sums)


def _place(sid: Column, emitted: Column) -> Column:
    """Where a pattern stands in the corpus, as one number, so that the first of many needs no sort."""
    return sid.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + emitted.cast("decimal(10,0)")


def pattern_pairs(sentences: DataFrame, placed: bool = False) -> DataFrame:
    """``pattern_key, realization, o, s``: occurrences of each pair, and, without a realization, sentences of each key.

    With ``placed``, ``at`` is the first place of a pair; sentences have a whole number ``sid`` then.  Everything that
    is counted of a corpus comes from this one pass.
    """
    struct = lambda k, r, o, s, at: F.struct(k.alias("pattern_key"), r.alias("realization"), F.lit(o).alias("o"), F.lit(s).alias("s"), *([at.alias("at")] if placed else []))
    none = F.lit(None)
    own = F.transform("patterns", lambda p, i: struct(p["pattern_key"], p["realization"], 1, 0, _place(F.col("sid"), i) if placed else none))
    keys = F.array_distinct(F.transform("patterns", lambda p: p["pattern_key"]))
    alone = F.transform(keys, lambda k: struct(k, none.cast("string"), 0, 1, none.cast("decimal(32,0)")))
    first = [F.min("at").alias("at")] if placed else []
    return sentences.select(F.inline(F.concat(own, alone))).groupBy("pattern_key", "realization").agg(F.sum("o").alias("o"), F.sum("s").alias("s"), *first)


def counts_of_pairs(pairs: DataFrame) -> DataFrame:
    """``pattern_key, count_occurrences, count_sentences, n_realizations``."""
    filled = F.count_if(F.coalesce(F.col("realization") != "", F.lit(False)))
    return pairs.groupBy("pattern_key").agg(F.sum("o").alias("count_occurrences"), F.sum("s").alias("count_sentences"), filled.alias("n_realizations"))


def first_realizations(pairs: DataFrame, cap: int = NO_CAP) -> DataFrame:
    """Distinct non-empty realizations of each key, the first ``cap`` by place (all if 0)."""
    filled = pairs.where(F.col("realization") != "")
    if cap > 0:
        order = Window.partitionBy("pattern_key").orderBy("at")
        filled = filled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return filled.select("pattern_key", "realization")


def pattern_counts(sentences: DataFrame) -> DataFrame:
    """``pattern_key, count_occurrences, count_sentences, n_realizations`` in one pass.

    (key, realization) pairs are counted first, with map-side sums.  A realization is told by two 64-bit hashes, so its text
    isn't shuffled; sentences of a key ride along, in rows of their own only where a sentence repeats a key.
    """
    keys, none = F.transform("patterns", lambda p: p["pattern_key"]), F.lit(None).cast("long")
    row = lambda k, h1, h2, o, s: F.struct(k.alias("pattern_key"), h1.alias("h1"), h2.alias("h2"), F.lit(o).alias("o"), F.lit(s).alias("s"))
    told = lambda r, seed: F.when(r != "", F.xxhash64(F.lit(seed), r))
    own = lambda s: F.transform("patterns", lambda p: row(p["pattern_key"], told(p["realization"], 1), told(p["realization"], 2), 1, s))
    distinct = F.array_distinct(keys)
    rows = F.when(F.size(distinct) == F.size(keys), own(1)).otherwise(F.concat(own(0), F.transform(distinct, lambda k: row(k, none, none, 0, 1))))
    pairs = sentences.select(F.inline(rows)).groupBy("pattern_key", "h1", "h2").agg(F.sum("o").alias("o"), F.sum("s").alias("s"))
    return pairs.groupBy("pattern_key").agg(F.sum("o").alias("count_occurrences"), F.sum("s").alias("count_sentences"), F.count("h1").alias("n_realizations"))


def with_share(stats: DataFrame, count: str = "count_sentences", share: str = "p_global") -> DataFrame:
    """Adds each row's share of the sum of ``count``; 0 if that is 0."""
    total = stats.agg(F.sum(count).alias("__total"))
    return stats.crossJoin(F.broadcast(total)).withColumn(share, F.when(F.col("__total") > 0, F.col(count) / F.col("__total")).otherwise(0.0)).drop("__total")


def realizations(patterns: DataFrame, cap: int = NO_CAP) -> DataFrame:
    """Distinct non-empty realizations of each key, the first ``cap`` in order of the corpus (all if 0).

    ``patterns`` has ``sid, emitted, pattern_key, realization``.
    """
    filled = patterns.where(F.col("realization") != "")
    if cap <= 0:
        return filled.select("pattern_key", "realization").distinct()
    first = filled.groupBy("pattern_key", "realization").agg(F.min(_place(F.col("sid"), F.col("emitted"))).alias("at"))
    return first_realizations(first, cap)


def prior(sentences: DataFrame, diversity: bool = False, cap: int = NO_CAP) -> DataFrame:
    """The global prior: counts, share and, with ``diversity``, distinct realizations up to ``cap``."""
    if not diversity:
        return prior_of_counts(key_counts(sentences))
    return prior_of_pairs(pattern_pairs(sentences), cap)


def prior_of_counts(counts: DataFrame) -> DataFrame:
    """Counts of keys with their share and family."""
    return with_share(counts).withColumn("family", family_of(F.col("pattern_key")))


def prior_of_pairs(pairs: DataFrame, cap: int = NO_CAP) -> DataFrame:
    """The prior with distinct realizations up to ``cap`` (0: all)."""
    return with_diversity(prior_of_counts(counts_of_pairs(pairs)), cap)


def with_diversity(stats: DataFrame, cap: int = NO_CAP) -> DataFrame:
    """``distinct_realization_count`` in place of ``n_realizations``, up to ``cap`` (0: all)."""
    n = F.col("n_realizations")
    return stats.withColumn("distinct_realization_count", F.least(n, F.lit(cap).cast("long")) if cap > 0 else n).drop("n_realizations")


def personal(sentences: DataFrame, seen_at: Column | None = None, min_count: int = 3, min_sentences: int = 2) -> DataFrame:
    """The personal state: what was seen, in how many sentences, and whether it has emerged."""
    counts = key_counts(sentences).withColumnsRenamed({"count_occurrences": "own_occurrences", "count_sentences": "own_sentences"})
    return personal_of_counts(counts, seen_at, min_count, min_sentences)


def personal_of_counts(counts: DataFrame, seen_at: Column | None = None, min_count: int = 3, min_sentences: int = 2) -> DataFrame:
    """The personal state by the ``own`` counts of :func:`key_counts`."""
    seen = counts.where("own_occurrences > 0").select("pattern_key", family_of(F.col("pattern_key")).alias("family"), F.col("own_occurrences").alias("count_seen"), F.col("own_sentences").alias("distinct_sentence_count"))
    when = (seen_at if seen_at is not None else F.lit(None)).cast("timestamp")
    return seen.withColumn("emerged", emerged(F.col("count_seen"), F.col("distinct_sentence_count"), min_count, min_sentences)).withColumn("last_seen_at", when)


def vocabulary(sentences: DataFrame, lexicon: DataFrame, tokens: str = "tokens", seen_at: Column | None = None) -> DataFrame:
    """``word, count, mastery`` with the lexicon's level and frequency where it has the word."""
    return vocabulary_of_counts(sentences.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("count")), lexicon, seen_at)


def vocabulary_of_counts(counts: DataFrame, lexicon: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """As :func:`vocabulary`, of each ``word`` and its ``count``."""
    known = lexicon.select(F.col("simplified").alias("word"), F.col("level").alias("hsk_level"), F.col("frequency").alias("hsk_frequency"))
    when = (seen_at if seen_at is not None else F.lit(None)).cast("timestamp")
    return counts.join(known, "word", "left").select("word", "count", mastery(F.col("count")).alias("mastery"), when.alias("last_seen"), "hsk_level", "hsk_frequency")


def best_entries(lexicon: DataFrame, max_level: int = 6, include_level7: bool = False) -> DataFrame:
    """The lexicon's rows within the levels, one per word: least level, then least frequency rank."""
    level = F.col("level")
    within = ((level <= max_level) | (level == 7)) if include_level7 else ((level <= max_level) & (level != 7))
    rank = F.struct(level, F.coalesce("frequency", F.lit(1_000_000_000)))
    usable = lexicon.where(within & (F.trim("simplified") != ""))
    rows = usable.groupBy("simplified").agg(F.min_by(F.struct(*[c for c in lexicon.columns if c != "simplified"]), rank).alias("e"))
    return rows.select("simplified", "e.*").select(*lexicon.columns)


def keep_first(sentences: DataFrame, existing: DataFrame | None = None, by: tuple[str, ...] = ("zh_text", "source"), order: str = "sid") -> DataFrame:
    """The first row of each ``by`` that ``existing`` lacks."""
    whole = F.struct(*sentences.columns)
    first = sentences.groupBy(*by).agg(F.min_by(whole, order).alias("row")).select("row.*")
    return first if existing is None else first.join(existing.select(*by), list(by), "left_anti").select(*sentences.columns)


def merge_counts(old: DataFrame, new: DataFrame, key: str = "pattern_key", sums: tuple[str, ...] = ("count_sentences", "count_occurrences"), maxima: tuple[str, ...] = ("distinct_realization_count",)) -> DataFrame:
    """Adds counts of two tables and keeps the larger maxima."""
    columns = [key, *sums, *maxima]
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
