"""Normalising, cleaning and splitting text.

White space means what Unicode calls so; the engine's ``trim`` and a plain
``\\s`` know ASCII only, hence the explicit class.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUOTES = "[“”\"'‘’]"
PARENTHETICALS = "（.*?）|\\(.*?\\)"
CITATIONS = r"\[[0-9]+\]"
LONG_RUN = "[A-Za-z0-9]{6,}"
CJK_RUN = "[一-龯，。！？、；：“”‘’（）…—]+"
TERMINATORS = "。！？"
SOUND = r"\[sound:[^\]]+\]"
KEPT_CHARACTER = r"[\x{4E00}-\x{9FFF}\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"
PUNCTUATION = r"[，。！？、；：…（）()“”" + '"' + r"'《》【】\[\]{}<>·—\-,.!?;:\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMBER = r"^\p{Nd}+(\.\p{Nd}+)?$"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def normalize(text: Column) -> Column:
    """Null becomes empty, runs of white space one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " "), "^ | $", "")


def _squeezed(text: Column) -> Column:
    """Without any white space and quotation marks."""
    return F.regexp_replace(F.regexp_replace(text, f"{WHITE}+", ""), QUOTES, "")


def clean_news(line: Column) -> Column:
    """A news line's sentence: what follows the first tab, without white space and quotes."""
    trimmed = strip(line)
    tab = F.instr(trimmed, "\t")
    return _squeezed(F.when(tab > 0, F.substring(trimmed, tab + 1, F.char_length(trimmed))).otherwise(trimmed))


def clean_wiki(text: Column) -> Column:
    """A wiki sentence without white space, quotes, parentheticals and citation marks."""
    return F.regexp_replace(F.regexp_replace(_squeezed(strip(text)), PARENTHETICALS, ""), CITATIONS, "")


def good_length(text: Column, least: int = 6, most: int = 60) -> Column:
    """Whether the length is in bounds and no long run of Latin letters and digits occurs."""
    return F.char_length(text).between(least, most) & ~text.rlike(LONG_RUN)


def split_sentences(text: Column) -> Column:
    """Sentences with their terminators; the rest after the last one too, even if empty."""
    return F.split(text, f"(?<=[{TERMINATORS}])")


#: What a reader of a page doesn't see: scripts, styles and comments.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
NUMERIC_ENTITY = "^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?"
NAMED_ENTITY = "^([A-Za-z][A-Za-z0-9]*);"
#: Latin names as the standard library lists them.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def unescape(text: Column) -> Column:
    """Entities as characters, each once: numeric ones, those of Latin names, and nothing else."""
    # one short list of names for each first letter
    listed = [[F.lit(x) for name, character in ENTITIES.items() if ord(name[0]) == c for x in (name, character)] for c in range(ord("A"), ord("z") + 1)]
    names = F.array(*[F.create_map(*own) if own else F.lit(None).cast("map<string,string>") for own in listed])

    def character(digits: Column) -> Column:
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def decoded(piece: Column) -> Column:
        digits, name = F.regexp_extract(piece, NUMERIC_ENTITY, 1), F.regexp_extract(piece, NAMED_ENTITY, 1)
        named = F.try_element_at(F.get(names, F.ascii(name) - ord("A")), name)
        return (
            F.when(digits != "", F.concat(character(digits), F.regexp_replace(piece, NUMERIC_ENTITY, "")))
            .when(named.isNotNull(), F.concat(named, F.substr(piece, F.char_length(name) + 2)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded), ""))


def html_text(html: Column) -> Column:
    """Text of HTML: no sound marks, scripts, styles and comments; tags become spaces, entities are decoded, spaces normalised."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), SOUND, ""), UNSEEN, " ")
    return normalize(unescape(F.regexp_replace(seen, "<[^>]*>", " ")))


def first_cjk_run(text: Column) -> Column:
    """The first run of CJK characters and punctuation, or nothing."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), CJK_RUN, 0)


def is_kept_character(character: Column) -> Column:
    return character.rlike(KEPT_CHARACTER)


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)
