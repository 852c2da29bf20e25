"""Corpus preparation, dictionaries, flash cards and anchors, file to file."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rewriting import Rewriter
from corpusloom.functions.text import first_cjk_run, html_text
from corpusloom.functions.tokenizers import Tokenizer, visible_characters
from corpusloom.operators import anchors as A
from corpusloom.operators import corpus
from corpusloom.sources import readers, sinks


def wiki_corpus(spark: SparkSession, root: str, out: str, simplify: Rewriter, min_len: int = 6, max_len: int = 60) -> None:
    """Wiki JSON lines to distinct good sentences in the script that ``simplify`` leaves as it is."""
    sinks.write_lines(corpus.distinct_lines(corpus.clean_wiki(readers.wiki_texts(spark, root), simplify, min_len, max_len)), out)


def news_corpus(spark: SparkSession, path: str, out: str, simplify: Rewriter, min_len: int = 6, max_len: int = 60) -> None:
    """News lines to distinct good sentences in the script that ``simplify`` leaves as it is."""
    raw = spark.read.text(path)
    sinks.write_lines(corpus.distinct_lines(corpus.clean_news(raw, simplify, min_len, max_len)), out)


def mixed_corpus(spark: SparkSession, first: str, n_first: int, second: str, n_second: int, out: str, seed: int = 7) -> None:
    """Samples of two corpora, shuffled, each line once; a corpus with fewer lines than asked for is a warning."""
    parts = (readers.lines(spark, first), n_first, first), (readers.lines(spark, second), n_second, second)
    for rows, k, path in parts:
        if (n := rows.limit(k).count()) < k:
            warnings.warn(f"{path} has {n} lines, {k} were asked for", stacklevel=2)
    (a, n_a, _), (b, n_b, _) = parts
    sinks.write_lines(corpus.mix(a, n_a, b, n_b, seed), out)


def flash_card_sentences(cards: DataFrame) -> DataFrame:
    """Distinct ``sentence_zh``: the first CJK run of a card's text."""
    text = html_text(F.concat_ws(" ", "front", "back"))
    return cards.select(first_cjk_run(text).alias("sentence_zh")).where("sentence_zh <> ''").distinct()


def flash_cards_to_csv(spark: SparkSession, path: str, out: str) -> None:
    sinks.write_csv(flash_card_sentences(readers.flash_cards(spark, path)), out)


def build_lexicon(spark: SparkSession, json_path: str, out: str) -> None:
    """Dictionary JSON to the lexicon table; of repeated words the best entry stays."""
    rows = readers.lexicon_rows(readers.dictionary(spark, json_path))
    rank = F.struct(F.coalesce("level", F.lit(999)), F.coalesce("frequency", F.lit(1_000_000_000)))
    best = rows.groupBy("simplified").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "simplified"]), rank).alias("e"))
    best.select("simplified", "e.*").write.mode("overwrite").parquet(out)


def global_candidates(spark: SparkSession, json_path: str, out: str | None = None, **options) -> DataFrame:
    """Anchor candidates of a dictionary by part of speech, and their file."""
    found = A.dictionary_candidates(readers.dictionary(spark, json_path), **options)
    if out is not None:
        sinks.write_text(spark, sinks.anchors_json([r["token"] for r in found.collect()]), out)
    return found


def corpus_anchors(spark: SparkSession, candidates: DataFrame, lines: DataFrame, out: str | None = None, max_len: int = 4, top_k: int = 400, min_df: int = 0, min_df_rate: float = 0.0, min_entropy: float = 0.0, tokenizer: Tokenizer = visible_characters) -> DataFrame:
    """The best candidates by their use in a corpus, and their file."""
    listed = [r["token"] for r in A.first_seen(candidates, "token", "ordinal", max_len).orderBy("ordinal").collect()]
    if not listed:
        raise ValueError("no candidates")
    sentences = lines.select(tokenizer(F.col("value")).alias("tokens"))
    chosen = A.final_anchors(A.score_candidates(sentences, listed), top_k, min_df, min_df_rate, min_entropy)
    if out is not None:
        rows = chosen.collect()
        stats = {r["token"]: {k: r[k] for k in ("df", "tf", "df_rate", "h_left", "h_right", "score")} for r in rows}
        meta = {"top_k": top_k, "min_df": min_df, "min_df_rate": min_df_rate, "min_entropy": min_entropy, "candidates": len(listed)}
        sinks.write_text(spark, sinks.anchors_json([r["token"] for r in rows], meta, stats), out)
    return chosen


def dump_vocabulary(spark: SparkSession, store: str, out: str) -> None:
    """The vocabulary table as CSV, most frequent words first."""
    sinks.write_csv(spark.read.parquet(f"{store}/vocab_stats").orderBy(F.desc("count"), "word"), out)
