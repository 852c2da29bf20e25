"""Coverage and set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_mass(personal: DataFrame, prior: DataFrame) -> DataFrame:
    """Number of emerged patterns and the sum of their prior shares; patterns the prior lacks add 0."""
    emerged = personal.where("emerged").select("pattern_key")
    joined = emerged.join(prior.select("pattern_key", "p_global"), "pattern_key", "left")
    return joined.agg(F.count("*").alias("emerged_patterns"), F.coalesce(F.sum(F.coalesce("p_global", F.lit(0.0))), F.lit(0.0)).alias("coverage_mass"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def idf_jaccard(pairs: DataFrame, df: DataFrame, total_docs: int | Column, key: str = "pattern_key") -> DataFrame:
    """``pair_id, similarity`` of pairs (``pair_id, a, b``) weighted by ``ln(N / max(1, df))``.

    Keys without a frequency count as 1.  A weight of the union that isn't positive gives 0.
    """
    each = pairs.select("pair_id", F.explode(F.array_union("a", "b")).alias(key), F.col("a"), F.col("b"))
    each = each.select("pair_id", key, (F.array_contains("a", F.col(key)) & F.array_contains("b", F.col(key))).alias("both"))
    n = total_docs if isinstance(total_docs, Column) else F.lit(total_docs)
    weight = F.ln(n / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)))
    weighed = each.join(df.select(key, "df"), key, "left").withColumn("w", weight)
    sums = weighed.groupBy("pair_id").agg(F.sum("w").alias("whole"), F.sum(F.when(F.col("both"), F.col("w"))).alias("shared"))
    value = F.when(F.col("whole") > 0, F.coalesce("shared", F.lit(0.0)) / F.col("whole")).otherwise(0.0)
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.coalesce(value, F.lit(0.0)).alias("similarity"))


def list_overlap(a: DataFrame, b: DataFrame, key: str = "token") -> DataFrame:
    """Sizes, intersection, share of ``a`` and Jaccard of two small lists."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, key, "full")
    n = both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))
    share = F.when(F.col("n_a") > 0, F.col("n_both") / F.col("n_a")).otherwise(0.0)
    return n.select("n_a", "n_b", "n_both", share.alias("share_of_a"), F.when(F.col("n_union") > 0, F.col("n_both") / F.col("n_union")).otherwise(1.0).alias("jaccard"))


def anchor_presence(anchors: DataFrame, top_patterns: DataFrame) -> DataFrame:
    """Each of a bounded list of anchors with the number of listed keys that hold it as text."""
    held = F.col("pattern_key").contains(F.col("token"))
    pairs = anchors.select("token").join(F.broadcast(top_patterns.select("pattern_key")), held, "left")
    return pairs.groupBy("token").agg(F.count("pattern_key").alias("n_keys"))


def anchor_presence_summary(anchors: DataFrame, top_patterns: DataFrame, first: int = 80) -> DataFrame:
    """One row: how many of the ``first`` anchors (by ``ordinal``) the listed keys hold, and whether that is suspiciously few.

    Few are less than 5 or less than 15 of 100 (rounded down): the prior may have been built with other anchors.
    """
    checked = anchors.orderBy("ordinal").limit(first)
    n = anchor_presence(checked, top_patterns).agg(F.count("*").alias("n_checked"), F.count_if(F.col("n_keys") > 0).alias("n_found"))
    least = F.greatest(F.lit(5).cast("long"), F.floor(F.col("n_checked") * 15 / 100))
    return n.select("n_checked", "n_found", F.when(F.col("n_checked") > 0, F.col("n_found") / F.col("n_checked")).otherwise(0.0).alias("share"), (F.col("n_found") < least).alias("is_low"))
