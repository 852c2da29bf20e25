"""Pattern families: from a sentence's tokens to its pattern keys.

Each family is one array expression over the tokens and the sentence's anchor
occurrences, so all patterns of a sentence come from one row without a join,
a shuffle or Python.  Loops over later anchors look at no more of them than
the distance bound lets in, so very long sentences cost in proportion to their length.

Duplicates within a sentence are kept and families emit in the order of
``FAMILIES``; both matter for counts and for capped realizations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keys import SLOT, escape, gap_bucket, key
from corpusloom.functions.text import is_number
from corpusloom.functions.tokenizers import ngrams

FAMILIES = ("tok_ng", "anch_win", "anch_pair", "anch_seq", "skel", "cskel", "anch_span", "span_sig", "a_skip2", "a_skip3")
DEFAULT_FAMILIES = ("anch_win", "anch_pair", "skel", "cskel")
END = "<END>"
SPAN = "<SPAN>"
_PATTERN = "array<struct<pattern_key:string,realization:string>>"


def membership(words: Iterable[str]) -> Callable[[Column], Column]:
    """A test for a bounded list of words; long lists become a hash set in the plan."""
    listed = sorted(set(words))
    return (lambda token: token.isin(listed)) if listed else (lambda token: F.lit(False))


def occurrences(tokens: Column, is_anchor: Callable[[Column], Column]) -> Column:
    """Anchor tokens (``t``, escaped ``e``) with their places (``i``, from 0), in order."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    found = F.filter(placed, lambda x: is_anchor(x["t"]))
    return F.transform(found, lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i"), escape(x["t"]).alias("e")))


def _pattern(pattern_key: Column, realization: Column) -> Column:
    return F.struct(pattern_key.alias("pattern_key"), realization.alias("realization"))


def _key_only(pattern_key: Column, realization: Column) -> Column:
    """A pattern whose realization nobody asks for, so that its text is never put together."""
    return _pattern(pattern_key, F.lit(None).cast("string"))


def _text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _between(tokens: Column, first: Column, last: Column) -> Column:
    """Tokens from place ``first`` to place ``last``, both included."""
    return F.slice(tokens, first + 1, last - first + 1)


def _text_of(number: Column) -> Column:
    return number.cast("string")


def token_ngrams(tokens, seq, is_anchor, max_n, make=_pattern):
    def family(n: int) -> Column:
        grams = F.filter(ngrams(tokens, n), lambda g: F.exists(g, is_anchor))
        shape = lambda g: _text(F.transform(g, lambda t: F.when(is_anchor(t), t).otherwise(SLOT)))
        return F.transform(grams, lambda g: make(key("tok_ng", F.filter(g, is_anchor), n=F.lit(str(n)), sig=shape(g)), _text(g)))

    return F.concat(*[family(n) for n in range(2, max_n + 1)]) if max_n >= 2 else F.array().cast(_PATTERN)


def anchor_windows(tokens, seq, is_anchor, reach=2, make=_pattern):
    last = F.size(tokens) - 1
    # each step binds what the next one uses more than once
    ends = F.transform(seq, lambda a: F.struct(F.least(a["i"], F.lit(reach)).alias("l"), F.least(last - a["i"], F.lit(reach)).alias("r"), a["i"].alias("i")))
    cut = F.transform(ends, lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), F.slice(tokens, x["i"] - x["l"] + 1, x["l"] + x["r"] + 1).alias("w")))

    def window(x: Column) -> Column:
        shape = _text(F.transform(x["w"], lambda t: F.when(is_anchor(t), t).otherwise(SLOT)))
        return make(key("anch_win", F.filter(x["w"], is_anchor), l=_text_of(x["l"]), r=_text_of(x["r"]), sig=shape), _text(x["w"]))

    return F.transform(cut, window)


def _later(seq: Column, k: Column, most: int, within: Callable[[Column], Column]) -> Column:
    """Occurrences behind the ``k``-th (from 0) that are ``within`` reach; at most ``most`` can be."""
    return F.filter(F.slice(seq, k + 2, F.lit(most)), within)


def _joined(family: str, anchors: list[Column], **params: Column) -> Column:
    """A key from escaped anchors and parameters that hold nothing to escape."""
    parts = [F.lit(f"{family}|a="), anchors[0]]
    for a in anchors[1:]:
        parts += [F.lit(","), a]
    for n, (name, value) in enumerate(sorted(params.items())):
        parts += [F.lit(f"{',' if n else '|p='}{name}="), value]
    return F.concat(*parts)


def anchor_pairs(tokens, seq, max_gap, make=_pattern):
    def pair(a: Column, b: Column) -> Column:
        return make(_joined("anch_pair", [a["e"], b["e"]], gap=gap_bucket(b["i"] - a["i"] - 1)), _text(_between(tokens, a["i"], b["i"])))

    near = lambda a, k: _later(seq, k, max_gap + 1, lambda b: b["i"] - a["i"] - 1 <= max_gap)
    return F.flatten(F.transform(seq, lambda a, k: F.transform(near(a, k), lambda b: pair(a, b))))


def anchor_sequence(seq, make=_pattern):
    anchors = F.transform(seq, lambda a: a["t"])
    return F.when(F.size(seq) >= 2, F.array(make(key("anch_seq", anchors), _text(anchors)))).otherwise(F.array().cast(_PATTERN))


def skeleton_text(tokens: Column, is_anchor: Callable[[Column], Column]) -> Column:
    """Anchors stay, other tokens become a class by number and length."""
    kind = lambda t: F.when(is_anchor(t), t).when(is_number(t), "<NUM>").when(F.char_length(t) == 1, "<C1>").when(F.char_length(t) == 2, "<C2>").otherwise("<W>")
    return _text(F.transform(tokens, kind))


def skeleton(tokens, seq, is_anchor, make=_pattern):
    return F.array(make(key("skel", F.transform(seq, lambda a: a["t"]), sig=skeleton_text(tokens, is_anchor)), _text(tokens)))


def compressed_skeleton(tokens, seq, make=_pattern):
    gap = lambda a, k: (k > 0) & (a["i"] - F.element_at(seq, F.greatest(k, F.lit(1)))["i"] > 1)
    shape = _text(F.transform(seq, lambda a, k: F.when(gap(a, k), F.concat(F.lit(SPAN + " "), a["t"])).otherwise(a["t"])))
    own = F.array(make(key("cskel", F.transform(seq, lambda a: a["t"]), sig=shape), _text(tokens)))
    return F.when(F.size(seq) > 0, own).otherwise(F.array().cast(_PATTERN))


def anchor_spans(tokens, seq, max_gap, signature=False, make=_pattern):
    n = F.size(tokens)
    nothing = F.struct(F.lit("").alias("t"), F.lit(-1).alias("i"), F.lit("").alias("e"))
    # every occurrence with the next one; the last one has none
    following = F.concat(F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(0))), F.array(nothing))
    paired = F.transform(seq, lambda a, k: F.struct(a.alias("a"), F.element_at(following, k + 1).alias("b")))
    closed = lambda x: (x["b"]["i"] >= 0) & (x["b"]["i"] - x["a"]["i"] <= max_gap)
    spans = F.transform(
        paired,
        lambda x: F.struct(
            x["a"]["i"].alias("i"), x["a"]["e"].alias("e"), F.when(closed(x), x["b"]["e"]).otherwise(END).alias("tail"),
            F.when(closed(x), x["b"]["i"]).otherwise(F.least(x["a"]["i"] + max_gap, n - 1)).alias("last"),
            F.when(closed(x), x["b"]["i"] - x["a"]["i"] - 1).otherwise(F.least(F.lit(max_gap), n - 1 - x["a"]["i"])).alias("gap"),
        ),
    )

    def span(x: Column) -> Column:
        # an interior holds no anchor, as it ends at the next one
        counts = {"kA": F.lit("0"), "kX": _text_of(x["gap"])} if signature else {}
        own = _joined("span_sig" if signature else "anch_span", [x["e"], x["tail"]], gap=gap_bucket(x["gap"]), **counts)
        return make(own, _text(_between(tokens, x["i"], x["last"])))

    return F.transform(spans, span)


def skip_grams(seq, max_jump, triples=False, make=_pattern):
    near = lambda a, k: _later(seq, k, max_jump, lambda b: b["i"] - a["i"] <= max_jump)
    jump = F.lit(str(max_jump))
    made = lambda family, *xs: make(_joined(family, [x["e"] for x in xs], max_jump=jump), F.concat_ws(" ... ", *[x["t"] for x in xs]))
    if not triples:
        return F.flatten(F.transform(seq, lambda a, k: F.transform(near(a, k), lambda b: made("a_skip2", a, b))))
    # the j-th occurrence near the k-th is number k + 1 + j of the sequence
    third = lambda a, b, at: F.transform(near(b, at), lambda c: made("a_skip3", a, b, c))
    return F.flatten(F.transform(seq, lambda a, k: F.flatten(F.transform(near(a, k), lambda b, j: third(a, b, k + 1 + j)))))


def pattern_array(tokens: Column, seq: Column, is_anchor: Callable[[Column], Column], families: Sequence[str] = DEFAULT_FAMILIES, max_ngram_n: int = 4, max_gap: int = 20, max_jump: int = 10, realizations: bool = True) -> Column:
    """All patterns of the chosen families as one array; without ``realizations`` those are null."""
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    make = _pattern if realizations else _key_only
    built = {
        "tok_ng": lambda: token_ngrams(tokens, seq, is_anchor, max_ngram_n, make=make),
        "anch_win": lambda: anchor_windows(tokens, seq, is_anchor, make=make),
        "anch_pair": lambda: anchor_pairs(tokens, seq, max_gap, make=make),
        "anch_seq": lambda: anchor_sequence(seq, make=make),
        "skel": lambda: skeleton(tokens, seq, is_anchor, make=make),
        "cskel": lambda: compressed_skeleton(tokens, seq, make=make),
        "anch_span": lambda: anchor_spans(tokens, seq, max_gap, make=make),
        "span_sig": lambda: anchor_spans(tokens, seq, max_gap, signature=True, make=make),
        "a_skip2": lambda: skip_grams(seq, max_jump, make=make),
        "a_skip3": lambda: skip_grams(seq, max_jump, triples=True, make=make),
    }
    chosen = [built[f]() for f in FAMILIES if f in families]
    return F.concat(*chosen) if chosen else F.array().cast(_PATTERN)


def extract(sentences: DataFrame, anchors: Iterable[str], **options) -> DataFrame:
    """Adds ``patterns`` to sentences with a column ``tokens``."""
    is_anchor = membership(anchors)
    placed = sentences.withColumn("__seq", occurrences(F.col("tokens"), is_anchor))
    return placed.withColumn("patterns", pattern_array(F.col("tokens"), F.col("__seq"), is_anchor, **options)).drop("__seq")


def explode(sentences: DataFrame) -> DataFrame:
    """One row per pattern: ``sid``, its place ``emitted``, ``pattern_key``, ``realization``.

    The rows come from a new array, so no filter on them can be inferred for, and evaluated on, the
    expressions below.
    """
    rows = F.transform("patterns", lambda p, i: F.struct(i.cast("int").alias("emitted"), p["pattern_key"].alias("pattern_key"), p["realization"].alias("realization")))
    return sentences.select("sid", F.inline(rows))
