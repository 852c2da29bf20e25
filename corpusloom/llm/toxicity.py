"""Toxicity: a counterfactually regularised logistic classifier over words.

Labelled texts become sets of word hashes on the executors; so does what their
counterfactuals change, in which every identity term is swapped for the next one of
its group.  The driver fits a logistic model on them whose loss also has
``fairness * (score - score of the counterfactual)^2``, the score before the logistic
function, so that the name of a
group carries no weight of its own: neutral mentions keep a low score, and
texts that are toxic for other reasons a high one.  The model says how many
labelled texts have a counterfactual (``changed``) and by how much the scores of
those differ from their counterfactuals' on average (``gap``); without any, a warning says that
the groups don't occur.

The fit uses at most ``max_labelled`` labelled rows with ``max_words`` different words together (a row's
words count for each row), two documented bounds: those rows
whose id has the smallest keyed hash, so a sample whatever the order of the
input.  Scoring takes every whole text.

Defined results: null and empty texts get the score of no words at all.  Rows
whose label is null teach nothing; a document with several labels counts as
toxic if one of them says so.  If there is nothing to learn from, or only one
class, the score is the share of toxic labels (0 without labels).  Repeated
rows are scored alike, and each teaches if its id is labelled.  A word of two groups is swapped within the
last one.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import held_out
from corpusloom.llm.storage import drop, materialize

_WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 400_000

#: Groups of terms that a neutral text may use for one another.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("he", "she"),
    ("him", "her"),
    ("his", "hers"),
    ("himself", "herself"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "arab", "mexican"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
    ("il", "elle"),
    ("ils", "elles"),
    ("er", "sie"),
    ("él", "ella"),
    ("ellos", "ellas"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Model:
    """Weights by word hash, the score's offset, and how the counterfactuals fared."""

    weights: dict[int, float]
    bias: float
    changed: int = 0
    gap: float = 0.0


def _swaps(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    return {word: group[(i + 1) % len(group)] for group in groups for i, word in enumerate(group)}


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _features(words: set[str]) -> bytes:
    return np.fromiter(map(_hash, words), np.int64, len(words)).tobytes()


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def labelled_features(docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]], max_labelled: int, seed: int = 17) -> DataFrame:
    """Word hashes of the rows to learn from, and of the words that their counterfactuals lose and gain."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    place = F.xxhash64(F.lit(seed), "doc_id").alias("place")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", "toxic", place).orderBy("place", "doc_id").limit(max_labelled)
    swaps = _swaps(groups)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lost, gained = [], [], []
            for text in batch.column(2).to_pylist():
                words = _words(text)
                other = {swaps.get(w, w) for w in words}
                own.append(_features(words))
                lost.append(_features(words - other))
                gained.append(_features(other - words))
            columns = [pa.array(x, pa.binary()) for x in (own, lost, gained)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["place", "toxic", "own", "lost", "gained"])

    # max_labelled ids and labels at most: a few MB by construction
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    return rows.mapInArrow(featurize, "place long, toxic int, own binary, lost binary, gained binary")


def _bounded(features: DataFrame, max_words: int) -> pd.DataFrame:
    """The rows of the smallest hashes that have at most ``max_words`` words together.

    Sizes are asked first, so no more words than that ever reach the driver.
    """
    features = materialize(features, "toxicity-features")
    # all rows of an id or none; ids are at most as many as were chosen
    sizes = features.groupBy("place").agg(F.sum(F.octet_length("own") / 8).alias("n")).toPandas().sort_values("place")
    within = sizes["place"][sizes["n"].cumsum() <= max_words]
    found = (features.where(F.col("place") <= int(within.iloc[-1])) if len(within) else features.limit(0)).toPandas()
    drop(features)
    # in one order, whatever order the tasks ended in
    return found.sort_values(["place", "own"]).reset_index(drop=True)


def _matrix(rows: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vocabulary positions of known words."""
    parts = [np.frombuffer(r, np.int64) for r in rows]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    if not len(vocabulary):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    return row[known], at[known]


def gradient(w: np.ndarray, b: float, y: np.ndarray, weight: np.ndarray, own: tuple, change: tuple, fairness: float, ridge: float) -> tuple[np.ndarray, float]:
    """Of the mean weighted logistic loss, ``ridge / 2 * |w|^2`` and ``fairness`` times the mean squared change of the score.

    ``own`` has row and column numbers of ones; ``change`` those of the counterfactuals' signs, the signs, and their number.
    """
    row, col = own
    n, v = len(y), len(w)
    z = b + np.bincount(row, w[col], n)
    gz = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
    g = np.bincount(col, gz[row], v) + ridge * w
    drow, dcol, dsign, changed = change
    if changed:
        dz = np.bincount(drow, dsign * w[dcol], changed)
        g += fairness * 2 / changed * np.bincount(dcol, dsign * dz[drow], v)
    return g, float(gz.sum())


def fit(docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, max_labelled: int = 20_000, max_words: int = 8_000_000, fairness: float = 1.0, ridge: float = 1e-4, lasso: float = 3e-4, min_docs: int = 5, steps: int = 300) -> Model:
    """Proximal gradient descent with momentum on the labelled rows outside the held-out fifth."""
    found = _bounded(labelled_features(docs, labels, groups, max_labelled), max_words)
    y = found["toxic"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    own, lost, gained = ([bytes(x) for x in found[c]] for c in ("own", "lost", "gained"))
    hashes, df = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in own]), return_counts=True)
    always = np.sort(np.array([_hash(w) for g in groups for w in g], np.int64))
    # a term that only counterfactuals have weighs nothing, so the one it is swapped for is drawn to nothing
    vocabulary = hashes[(df >= min_docs) | np.isin(hashes, always)]
    row, col = _matrix(own, vocabulary)
    at = [i for i in range(len(y)) if lost[i] or gained[i]]
    (row1, col1), (row2, col2) = (_matrix([x[i] for i in at], vocabulary) for x in (lost, gained))
    signs = np.concatenate((-np.ones(len(row1)), np.ones(len(row2))))
    change = np.concatenate((row1, row2)), np.concatenate((col1, col2)), signs, len(at)
    if not at and groups:
        warnings.warn("no labelled text holds a term of the identity groups: nothing is regularised", stacklevel=2)
    n, v = len(y), len(vocabulary)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight)  # half way to balanced classes
    weight *= n / weight.sum()
    w, b = np.zeros(v), 0.0
    mw, vw, mb, vb, rate = np.zeros(v), np.zeros(v), 0.0, 0.0, 0.05
    for step in range(1, steps + 1):
        g, gb = gradient(w, b, y, weight, (row, col), change, fairness, ridge)
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        scale = rate / (np.sqrt(vw / c) + 1e-3)
        w = w - scale * mw / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * lasso, 0)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-3)
    kept = np.flatnonzero(w)
    gap = float(np.abs(np.bincount(change[0], signs * w[change[1]], len(at))).mean()) if at else 0.0
    return Model({int(vocabulary[i]): float(w[i]) for i in kept}, float(b), len(at), gap)


class _Weights(dict):
    """Weight of a word, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self._model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        weight = self[word] = self._model.weights.get(_hash(word), 0.0)
        return weight


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _Weights(shared.value), shared.value.bias
        for batch in batches:
            z = np.array([bias + sum(sorted(filter(None, map(weights.__getitem__, _words(t))))) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit outside the held-out fifth, score every row."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
