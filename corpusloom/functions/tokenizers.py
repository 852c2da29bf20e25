"""Tokenisers: columns of text to columns of token arrays.

A tokeniser is any ``Column -> Column`` function, so another segmenter can be
passed wherever one is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import KEPT_CHARACTER, PUNCTUATION, WHITE, normalize

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def characters(text: Column) -> Column:
    """CJK characters and digits, one token each; anything else is dropped."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEPT_CHARACTER), F.lit(0))


def visible_characters(text: Column) -> Column:
    """Every character that isn't white space; punctuation stays."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE[1:-1]}]"), F.lit(0))


class _Node(dict):
    """A trie node: next characters, and whether a word ends here."""

    ends = False


def usable(lexicon: Iterable[str], any_start: bool = False) -> Iterator[str]:
    """The words that tokenisers look for; those that begin with punctuation are left out, as it is skipped first, unless ``any_start``."""
    skipped = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), PUNCTUATION))
    return (word for word in lexicon if word and (any_start or not skipped.match(word)))


#: Branches of a node that are tried one after the other; more are halved until so few are left.
FEW_BRANCHES = 4


def trie_pattern(lexicon: Iterable[str], any_start: bool = False) -> str:
    """A regular expression that matches the longest word at a place, sharing prefixes.

    Where many characters may follow, the next one is looked for by halves of their range, so a place
    costs in proportion to the logarithm of the number of characters and not to the number of words.
    """
    root = _Node()
    for word in usable(lexicon, any_start):
        node = root
        for c in word:
            node = node.setdefault(c, _Node())
        node.ends = True

    def either(children: list[tuple[str, _Node]]) -> str:
        if len(children) <= FEW_BRANCHES:
            return "|".join(re.escape(c) + write(child) for c, child in children)
        half = len(children) // 2
        low, high = (children[i][0] for i in (0, half - 1))
        return rf"(?=[\x{{{ord(low):X}}}-\x{{{ord(high):X}}}])(?:{either(children[:half])})|(?:{either(children[half:])})"

    def write(node: _Node) -> str:
        if not node:
            return ""
        body = either(sorted(node.items()))
        if len(node) > 1 or node.ends:
            body = f"(?:{body})"
        return body + ("?" if node.ends else "")

    return write(root)


def lexicon_words(lexicon: Iterable[str]) -> Tokenizer:
    """Longest words of ``lexicon`` first; other kept characters are tokens of their own.

    The lexicon is compiled into one expression, so its size must be that of a
    vocabulary; nothing is looked up per row.
    """
    pattern = trie_pattern(lexicon)
    either = f"{pattern}|{KEPT_CHARACTER}" if pattern else KEPT_CHARACTER

    def tokenize(text: Column) -> Column:
        return F.regexp_extract_all(normalize(text), F.lit(either), F.lit(0))

    return tokenize


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous runs of ``n`` tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, F.lit(n)))
