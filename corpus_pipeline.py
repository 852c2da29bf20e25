"""A training-data pipeline over the documents table, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and its result is written as Parquet in
the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, line_dedup, minhash_dedup, sentencepiece_codec
from corpusloom.llm.queries import tokenizer_path
from corpusloom.llm.storage import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be determined."""
    return language_id.accept(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line resembles, and documents of which no line is left."""
    return line_dedup.remove_later(docs, min_words=1)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles one stays."""
    return minhash_dedup.keep_first(docs, k=5, percent=80)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, their number, checksum and whether they decode to the text; columns of those names give way."""
    encoded = sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"), dropout=0.1, seed=1, keep=tuple(docs.columns), cached_chunks=300_000, forget=True)
    own = ["ids", "n_tokens", "ids_crc32", "lossless"]
    return encoded.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", remove_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: The first stage is learned and the last one uses a tokenizer file; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
