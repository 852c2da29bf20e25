"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of lower-cased letters (every other character
is a word boundary) of all training texts in one distributed pass; counts are
added per task before the shuffle, so a task ships at most ``languages x
buckets`` numbers whatever its input.  The log-probability matrix, of that same
bounded size, is broadcast, and texts are scored in numpy: one gather from the
matrix and one segmented sum for a block of documents.

Defined results: a text that is null or has no letter gets ``und`` and score 0,
as does every text when nothing could be learned.  More than ``max_languages`` languages are an error.  Rows whose ``lang`` or text
is null teach nothing.  Repeated rows are scored alike; ties between languages go to
the first in alphabetical order.  Long texts are scored whole, in slices.
Extra columns are ignored by training and kept out of the result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import beside, held_out, release_memory

BITS = 14
BUCKETS = 1 << BITS
SLICE_CHARS = 1 << 19
UNDETERMINED = "und"
_MULTIPLIERS = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order; per n-gram bucket their log probabilities.

    The last row of ``log_prob`` is zero: grams without a letter point at it.
    """

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, where each piece begins, its document) for pieces of texts.

    Pieces begin with a boundary; a long text is cut into slices that overlap by
    two characters, whose grams the slice before already had.
    """
    codes, starts, owners, size = [], [], [], 0
    for i, text in enumerate(texts):
        low = " " + (text or "").lower() + " "
        for at in range(0, max(len(low) - 2, 1), SLICE_CHARS):
            piece = low[at : at + SLICE_CHARS + 2]
            codes.append(piece)
            starts.append(size)
            owners.append(i)
            size += len(piece)
            if size >= SLICE_CHARS:
                yield _code_points(codes), np.array(starts), np.array(owners)
                codes, starts, owners, size = [], [], [], 0
    if codes:
        yield _code_points(codes), np.array(starts), np.array(owners)


def _code_points(pieces: list[str]) -> np.ndarray:
    return np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that end at each position, and the letters."""
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    products = [codes * m for m in _MULTIPLIERS]
    one = (products[0] ^ np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    two = products[0].copy()
    two[1:] += products[1][:-1]
    two = (two ^ np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    three = products[0].copy()
    three[1:] += products[1][:-1]
    three[2:] += products[2][:-2]
    three >>= np.uint32(32 - BITS)
    none = np.uint32(BUCKETS)
    one[~letter] = none
    space = ~letter
    both = space.copy()
    both[1:] &= space[:-1]
    two[both] = none
    three[both] = none
    # a piece's first two positions have no full gram of their own
    for gram, short in ((two, 1), (three, 2)):
        for back in range(short):
            at = starts + back
            gram[at[at < len(gram)]] = none
    # a slice repeats the two characters before it: those are only context
    return [one, two, three], letter


def _first_of_text(owners: np.ndarray, before: int | None) -> np.ndarray:
    first = np.ones(len(owners), bool)
    first[1:] = owners[1:] != owners[:-1]
    if before is not None and len(owners) and owners[0] == before:
        first[0] = False
    return first


def _blocks_of_grams(texts: list[str | None]):
    """For each block: gram buckets, piece starts, owners, letters per piece."""
    before = None
    for codes, starts, owners in _blocks(texts):
        grams, letter = _grams(codes, starts)
        again = starts[~_first_of_text(owners, before)]
        for back in range(2):  # the overlap's letters and pairs were counted in the slice before
            at = again + back
            at = at[at < len(codes)]
            grams[0][at] = BUCKETS
            grams[1][at] = BUCKETS
        yield grams, starts, owners, np.add.reduceat(letter, starts, dtype=np.int64)
        before = int(owners[-1])


def fit(training: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5, max_languages: int = 1000) -> Model:
    """Count grams of every row of ``training`` whose text and language are set.

    More than ``max_languages`` different values of ``lang`` are an error: the matrix, which has a column for
    each, is held by every task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(k, []).append(t)
            for k, texts in by_lang.items():
                total = counts.setdefault(k, np.zeros(BUCKETS + 1, np.int64))
                docs[k] = docs.get(k, 0) + len(texts)
                for grams, _, _, _ in _blocks_of_grams(texts):
                    for gram in grams:
                        total += np.bincount(gram, minlength=BUCKETS + 1)
        for k, total in counts.items():
            at = np.flatnonzero(total[:BUCKETS])
            ns = np.append(total[at], docs[k])
            at = np.append(at, -1)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at, pa.int32()), pa.array(ns, pa.int64())], ["lang", "bucket", "n"])

    rows = training.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    counts = np.zeros((BUCKETS + 1, len(languages)))
    docs = np.zeros(len(languages))
    for j, k in enumerate(languages):
        own = found[found["lang"] == k]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), j] = grams["n"].to_numpy()
        docs[j] = own[own["bucket"] == -1]["n"].sum()
    smooth = counts[:BUCKETS] + smoothing
    log_prob = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    log_prob[:BUCKETS] = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    return Model(languages, log_prob, np.log(docs / docs.sum()) if len(languages) else docs)


def _score(model: Model, texts: list[str | None], evidence: int) -> tuple[list[str], list[float]]:
    n = len(texts)
    k = len(model.languages)
    sums = np.zeros((n, k))
    grams_seen = np.zeros(n)
    letters = np.zeros(n, np.int64)
    for grams, starts, owners, letter in _blocks_of_grams(texts):
        np.add.at(letters, owners, letter)
        for gram in grams:
            np.add.at(sums, owners, np.add.reduceat(model.log_prob[gram], starts, axis=0, dtype=np.float64))
            np.add.at(grams_seen, owners, np.add.reduceat(gram != BUCKETS, starts, dtype=np.int64))
    best = np.argmax(sums + model.log_prior, axis=1)
    # the mean evidence of a gram, times a bounded number of grams: long texts don't all end at 1
    scale = np.minimum(grams_seen, evidence) / np.maximum(grams_seen, 1)
    odds = sums * scale[:, None] + model.log_prior
    odds -= odds[np.arange(n), best][:, None]
    score = 1.0 / np.exp(np.minimum(odds, 50.0)).sum(axis=1)
    langs = [model.languages[b] if has else UNDETERMINED for b, has in zip(best, letters, strict=True)]
    return langs, [float(s) if has else 0.0 for s, has in zip(score, letters, strict=True)]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), evidence: int = 60) -> DataFrame:
    """For every row of ``docs``: ``row`` (a struct of the ``keep`` columns), ``lang_pred`` and ``score``."""
    source, columns = beside(docs, [text], keep)
    schema = source.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    if not model.languages:
        return source.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch)
            langs, scores = _score(shared.value, texts.to_pylist(), evidence)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])
        release_memory()

    return source.mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fifth and predict every row."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language was determined with ``min_score``."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    marked = predict(docs, model, keep=tuple(docs.columns))
    return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
