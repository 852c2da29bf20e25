"""Word segmentation by a lexicon with frequencies, in array expressions.

All words of the lexicon that occur in a text make a graph over its places; the segmentation is the path of the
largest probability, a word's probability being its share of the frequencies.  The path is
found by dynamic programming, folded over the places from the last to the first, and read off from the first to the last.
The lexicon is a hash table inside the plan: an array of buckets that a word's hash
points into, with the longest word that begins with a unit beside that unit, so that nothing is joined,
shuffled or sent to Python, and a place is probed no further than words reach.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lookup import LookupTable, lookup_table
from corpusloom.functions.text import PUNCTUATION, WHITE, normalize
from corpusloom.functions.tokenizers import Tokenizer

#: Scores are whole numbers, so that equal paths are equal in any order of adding.
SCALE = 1_000_000
_HAN = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: Han characters one by one; letters and digits of other scripts in runs, as no word ends within them.
UNITS = rf"[{_HAN}]|[\p{{L}}\p{{Nd}}&&[^{_HAN}]]+"
#: What makes up words; anything else parts them.
BLOCK = r"[\p{L}\p{Nd}]+"
#: Every character one by one, for scripts that are written without spaces.
CHARACTERS = "."


@dataclass(frozen=True)
class Lexicon:
    """Words with scores, ready for use in expressions; made by :func:`lexicon`."""

    table: LookupTable
    unknown: int
    unit: str

    def _steps(self, units: Column) -> Column:
        """For every place of ``units`` the number of units of the best word there; ties go to the longer word."""
        n = F.size(units)
        zero = F.struct(F.array(F.lit(0).cast("long")).alias("scores"), F.array().cast("array<int>").alias("steps"))

        def best(state: Column, at: Column, back: Column, first: Column) -> Column:
            def path(score: Column, length: Column) -> Column:
                return F.struct((score + F.element_at(state["scores"], length)).alias("score"), length.alias("length"))

            reach = F.least(F.coalesce(first["reach"], F.lit(1)), back)
            longer = F.when(reach > 1, F.sequence(F.lit(2), reach)).otherwise(F.array().cast("array<int>"))
            words = F.transform(longer, lambda length: path(self.table.get(F.array_join(F.slice(units, at + 1, length), ""))["score"], length))
            alone = path(F.coalesce(first["score"], F.lit(self.unknown)), F.lit(1))
            return F.array_max(F.concat(F.array(alone), F.filter(words, lambda p: p["score"].isNotNull())))

        def step(state: Column, back: Column) -> Column:
            at = n - back
            chosen = F.transform(F.array(self.table.get(F.element_at(units, at + 1))), lambda first: best(state, at, back, first))
            onward = F.transform(chosen, lambda p: F.struct(F.concat(F.array(p["score"]), state["scores"]).alias("scores"), F.concat(F.array(p["length"]), state["steps"]).alias("steps")))
            return F.element_at(onward, 1)

        return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda s: s["steps"])

    def _block(self, block: Column) -> Column:
        """The words of a run of units."""
        units = F.regexp_extract_all(block, F.lit(self.unit), F.lit(0))
        empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("words"))

        def walked(units: Column, steps: Column) -> Column:
            def walk(state: Column, place: Column) -> Column:
                length = F.element_at(steps, place + 1)
                word = F.array(F.array_join(F.slice(units, place + 1, length), ""))
                onward = F.struct((place + length).alias("next"), F.concat(state["words"], word).alias("words"))
                return F.when(place == state["next"], onward).otherwise(state)

            return F.aggregate(F.sequence(F.lit(0), F.size(units) - 1), empty, walk, lambda s: s["words"])

        # the element of an array is computed once, whatever it is used for
        graphs = F.transform(F.array(units), lambda u: F.struct(u.alias("units"), self._steps(u).alias("steps")))
        return F.element_at(F.transform(graphs, lambda g: walked(g["units"], g["steps"])), 1)

    def words(self, keep_punctuation: bool = False) -> Tokenizer:
        """The tokeniser; other visible characters are dropped, or tokens of their own."""
        other = f"|[^{WHITE[1:-1]}]" if keep_punctuation else ""

        def tokenize(text: Column) -> Column:
            blocks = F.regexp_extract_all(normalize(text), F.lit(BLOCK + other), F.lit(0))
            cut = F.transform(blocks, lambda b: F.when(b.rlike(f"^{BLOCK}"), self._block(b)).otherwise(F.array(b)))
            found = F.flatten(cut)
            return found if keep_punctuation else F.filter(found, lambda w: ~w.rlike(f"^{PUNCTUATION}+$"))

        return tokenize


def lexicon(entries: DataFrame, word: str = "simplified", frequency: str = "frequency", unit: str = UNITS, ranks: bool = False) -> Lexicon:
    """The lexicon of the rows with a word and a frequency of at least 1; repeated words add up.

    A unit that is no word counts as one of frequency 1.  A word that units don't make up is left out.  With ``ranks``, as
    dictionaries have them, a word of rank r counts as one of frequency 1,000,000 / r.
    """
    w, n = F.col(word), F.col(frequency)
    counted = F.greatest(F.rint(F.lit(1_000_000) / n), F.lit(1.0)).cast("long") if ranks else n
    known = entries.where(w.isNotNull() & (w != "") & (n >= 1)).groupBy(w.alias("key")).agg(F.sum(counted).alias("n"))
    parts = F.regexp_extract_all("key", F.lit(unit), F.lit(0))
    known = known.where(F.array_join(parts, "") == F.col("key")).select("key", "n", F.get(parts, F.lit(0)).alias("first"), F.size(parts).alias("length"))
    total = max(known.agg(F.sum("n").alias("total")).first()["total"] or 1, 1)
    score = F.rint(F.ln(F.col("n") / F.lit(float(total))) * SCALE).cast("long")
    words = known.select("key", score.alias("score"), F.lit(None).cast("int").alias("reach"))
    firsts = known.groupBy(F.col("first").alias("key")).agg(F.lit(None).cast("long").alias("score"), F.max("length").alias("reach"))
    rows = words.unionByName(firsts).groupBy("key").agg(F.max("score").alias("score"), F.max("reach").alias("reach"))
    return Lexicon(lookup_table(rows), round(math.log(1 / total) * SCALE), unit)
