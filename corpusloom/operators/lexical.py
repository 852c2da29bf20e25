"""Longest words of a vocabulary, found once for each different run of characters.

The tokens are those of :func:`corpusloom.functions.tokenizers.lexicon_words`.  Unless a word holds white space none of them reaches
over it, so a text is cut there, and a task takes each run that it meets apart once while it remembers it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusloom.functions.text import KEPT_CHARACTER, WHITE, normalize
from corpusloom.functions.tokenizers import usable

#: Runs that a task remembers, their longest length, and words whose counts it holds.
REMEMBERED, SHORT, HELD = 200_000, 64, 300_000


@dataclass(frozen=True)
class RunLexicon:
    """Beginnings of words and whether they are words, characters that are tokens of their own elsewhere, and whether no word holds white space."""

    beginnings: dict[str, bool]
    kept: frozenset[str]
    cut: bool

    def runs(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE[1:-1]}]+"), F.lit(0)) if self.cut else F.array(normalize(text))

    def split(self, run: str) -> list[str]:
        at, found = 0, []
        while at < len(run):
            end = at
            for i in range(at + 1, len(run) + 1):
                is_word = self.beginnings.get(run[at:i])
                if is_word is None:
                    break
                if is_word:
                    end = i
            if end > at or run[at] in self.kept:
                found.append(run[at : max(end, at + 1)])
            at = max(end, at + 1)
        return found

    def remembering(self) -> Callable[[str], list[str]]:
        met: dict[str, list[str]] = {}

        def split(run: str) -> list[str]:
            found = met.get(run)
            if found is None:
                found = self.split(run)
                if len(run) <= SHORT:
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[run] = found
            return found

        return split


def run_lexicon(spark: SparkSession, lexicon: Iterable[str]) -> RunLexicon:
    words = set(usable(lexicon))
    beginnings = {w[:i]: False for w in words for i in range(1, len(w))} | dict.fromkeys(words, True)
    # by the engine's own tables of characters; surrogates aren't characters
    every = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    white = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), WHITE))
    return RunLexicon(beginnings, frozenset(r["c"] for r in every.where(F.col("c").rlike(KEPT_CHARACTER)).collect()), not any(white.search(w) for w in words))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    starts = lists.offsets.to_numpy().astype("int64")
    return starts - starts[0], lists.values.slice(starts[0], starts[-1] - starts[0])


def with_tokens(sentences: DataFrame, lexicon: RunLexicon, text: Column, name: str) -> DataFrame:
    """Sentences and the tokens of their ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lexicon.remembering()
        for batch in batches:
            starts, flat = _flat(batch.column(name))
            encoded = flat.dictionary_encode()
            parts, ids = [split(r) for r in encoded.dictionary.to_pylist()], encoded.indices.to_numpy()
            sizes = np.array([len(p) for p in parts], "int64")
            each = sizes[ids]
            ends = np.concatenate([np.zeros(1, "int64"), np.cumsum(each)])
            # the tokens of a run stand together in the list of all
            at = np.repeat((np.cumsum(sizes) - sizes)[ids] - ends[:-1], each) + np.arange(ends[-1])
            tokens = pa.array([t for p in parts for t in p], pa.string()).take(pa.array(at))
            columns = {**dict(zip(batch.schema.names, batch.columns)), name: pa.ListArray.from_arrays(ends[starts].astype("int32"), tokens)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return sentences.withColumn(name, lexicon.runs(text)).mapInArrow(run, StructType([*sentences.schema.fields, StructField(name, ArrayType(StringType()))]))


def word_counts(sentences: DataFrame, lexicon: RunLexicon, text: Column) -> DataFrame:
    """``word, count`` of the tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, sums = lexicon.remembering(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            found = pc.value_counts(_flat(batch.column(0))[1])
            for r, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                for token in split(r):
                    sums[token] += n
            if len(sums) > HELD:
                yield rows()
                sums.clear()
        yield rows()

    return sentences.select(lexicon.runs(text).alias("runs")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))
