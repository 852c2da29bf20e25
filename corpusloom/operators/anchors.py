"""Token statistics and the choice of anchors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.statistics import anchor_score
from corpusloom.operators.patterns import membership

BEGIN, FINISH = "<BOS>", "<EOS>"


def token_tf(sentences: DataFrame) -> DataFrame:
    """Occurrences of each token."""
    return sentences.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("tf"))


def token_df(sentences: DataFrame) -> DataFrame:
    """Sentences of each token; repetitions are dropped inside the row, so nothing but tokens is shuffled."""
    return sentences.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _eligible(tokens: DataFrame, max_token_len: int, allowed: DataFrame | None) -> DataFrame:
    short = tokens.where(F.char_length("token") <= max_token_len)
    return short if allowed is None else short.join(allowed.select("token").distinct(), "token", "left_semi")


def top_tokens(sentences: DataFrame, top_k: int = 60, method: str = "df", max_token_len: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` most frequent tokens as ``token, n``; ties in order of the token."""
    counted = {"df": token_df, "tf": token_tf}
    if method not in counted:
        raise ValueError(f"method must be df or tf, not {method!r}")
    n = counted[method](sentences).withColumnRenamed(method, "n")
    return _eligible(n, max_token_len, allowed).orderBy(F.desc("n"), "token").limit(top_k)


def anchor_list(tokens: DataFrame) -> list[str]:
    """A chosen, hence bounded, list of anchors in order."""
    return sorted(r["token"] for r in tokens.select("token").collect())


def _around(wanted) -> Column:
    """Every occurrence of a candidate as ``token, l, r``: itself and its neighbours, with marks for sentence ends."""
    tokens, n = F.col("tokens"), F.size("tokens")
    left = lambda i: F.when(i > 0, F.element_at(tokens, F.greatest(i, F.lit(1)))).otherwise(BEGIN)
    right = lambda i: F.when(i + 1 < n, F.element_at(tokens, F.least(i + 2, n))).otherwise(FINISH)
    return F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), left(i).alias("l"), right(i).alias("r"))), lambda x: wanted(x["token"]))


def _row(token: Column, side: str, neighbour: Column) -> Column:
    return F.struct(token.alias("token"), F.lit(side).alias("side"), neighbour.alias("neighbour"))


def neighbours(sentences: DataFrame, candidates: Iterable[str]) -> DataFrame:
    """``token, side, neighbour`` of every candidate occurrence."""
    found = sentences.select(F.explode(_around(membership(candidates))).alias("x"))
    return found.select(F.inline(F.array(_row(F.col("x.token"), "l", F.col("x.l")), _row(F.col("x.token"), "r", F.col("x.r")))))


def neighbour_entropy(sentences: DataFrame, candidates: Iterable[str]) -> DataFrame:
    """``token, h_left, h_right``: how varied the neighbours are, in nats."""
    counts = neighbours(sentences, candidates).groupBy("token", "side", "neighbour").agg(F.count("*").alias("c"))
    # H = ln N - sum(c ln c) / N
    each = counts.groupBy("token", "side").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    h = F.ln("n") - F.col("s") / F.col("n")
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, h)), F.lit(0.0))
    return each.groupBy("token").agg(side("l").alias("h_left"), side("r").alias("h_right"))


def score_candidates(sentences: DataFrame, candidates: Iterable[str]) -> DataFrame:
    """``token, df, tf, df_rate, h_left, h_right, entropy, score`` of the candidates that occur.

    A sentence sends the neighbours of its candidates, each candidate once, and itself, so lines, both
    frequencies and both entropies come from one pass and one aggregation.
    """
    wanted = membership(list(candidates))
    none = F.lit(None).cast("string")
    around = _around(wanted)
    sides = F.concat(F.transform(around, lambda x: _row(x["token"], "l", x["l"])), F.transform(around, lambda x: _row(x["token"], "r", x["r"])))
    once = F.transform(F.array_distinct(F.filter("tokens", wanted)), lambda t: _row(t, "once", none))
    rows = sentences.where(F.size("tokens") > 0).select(F.inline(F.concat(sides, once, F.array(_row(none, "line", none)))))
    counts = rows.groupBy("token", "side", "neighbour").agg(F.count("*").alias("c"))
    lines = counts.where("side = 'line'").agg(F.sum("c").alias("lines"))
    of = lambda side, x: F.sum(F.when(F.col("side") == side, x))
    c = F.col("c")
    sums = counts.where("side <> 'line'").groupBy("token").agg(of("once", c).alias("df"), *[x for s in ("l", "r") for x in (of(s, c).alias(f"n_{s}"), of(s, c * F.ln(c)).alias(f"s_{s}"))])
    # H = ln N - sum(c ln c) / N
    h = lambda s: F.ln(f"n_{s}") - F.col(f"s_{s}") / F.col(f"n_{s}")
    scored = sums.crossJoin(F.broadcast(lines)).select("token", "df", F.col("n_l").alias("tf"), (F.col("df") / F.col("lines")).alias("df_rate"), h("l").alias("h_left"), h("r").alias("h_right"))
    scored = scored.withColumn("entropy", (F.col("h_left") + F.col("h_right")) / 2)
    return scored.withColumn("score", anchor_score(F.col("df_rate"), F.col("entropy"), F.col("tf")))


def final_anchors(scored: DataFrame, top_k: int = 400, min_df: int = 0, min_df_rate: float = 0.0, min_entropy: float = 0.0) -> DataFrame:
    """The best scored candidates above the inclusive thresholds; ties in order of the token."""
    enough = (F.col("df") >= min_df) & (F.col("df_rate") >= min_df_rate) & (F.col("entropy") >= min_entropy)
    return scored.where(enough).orderBy(F.desc("score"), "token").limit(max(top_k, 0))


def first_seen(candidates: DataFrame, value: str, place: str, max_len: int | None = None) -> DataFrame:
    """Distinct values by their first place, short ones only if asked for."""
    once = candidates.groupBy(value).agg(F.min(place).alias(place))
    return once if max_len is None else once.where(F.char_length(value) <= max_len)


def dictionary_candidates(entries: DataFrame, pos: Iterable[str] = ("u", "p", "c", "y", "e"), max_len: int = 4, min_level: int = 1, max_level: int = 7, sort_by: str = "frequency") -> DataFrame:
    """Dictionary words (``ordinal, simplified, level, frequency, pos``) of the wanted parts of speech, ordered.

    Words without a level pass; words without a frequency come last.
    """
    if sort_by not in ("frequency", "alpha"):
        raise ValueError(f"sort_by must be frequency or alpha, not {sort_by!r}")
    wanted = F.array(*[F.lit(p) for p in pos]).cast("array<string>")
    level = F.col("level")
    fits = (F.col("simplified") != "") & (F.char_length("simplified") <= max_len) & (level.isNull() | level.between(min_level, max_level)) & F.arrays_overlap("pos", wanted)
    rank = F.coalesce("frequency", F.lit(1_000_000_000))
    once = entries.where(fits).groupBy("simplified").agg(F.min_by(F.struct(rank.alias("frequency"), "ordinal"), "ordinal").alias("e"))
    rows = once.select(F.col("simplified").alias("token"), "e.frequency", "e.ordinal")
    return rows.orderBy("frequency", "ordinal") if sort_by == "frequency" else rows.orderBy("token")


def zero_df(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    """Anchors that no sentence has."""
    return anchors.select("token").join(token_df(sentences), "token", "left_anti")
