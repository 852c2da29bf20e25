"""Optional exact tokenisers and converters, for where their packages are installed.

They run as Arrow-batched pandas functions; the library's own defaults don't.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import PUNCTUATION, normalize
from corpusloom.functions.tokenizers import Tokenizer


def jieba_words(keep_punctuation: bool = False) -> Tokenizer:
    """Word segmentation by ``jieba``; raises ImportError without it."""
    import jieba  # noqa: F401

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        import jieba as own

        return texts.map(lambda t: [w.strip() for w in own.cut(t or "", cut_all=False) if w.strip()])

    def tokenize(text: Column) -> Column:
        words = cut(normalize(text))
        return words if keep_punctuation else F.filter(words, lambda w: ~w.rlike(f"^{PUNCTUATION}+$"))

    return tokenize


def opencc_simplified(config: str = "t2s") -> Callable[[Column], Column]:
    """Whether a text is unchanged by ``opencc``; raises ImportError without it."""
    import opencc  # noqa: F401

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        from opencc import OpenCC

        converter = OpenCC(config)
        return texts.map(lambda t: None if t is None else converter.convert(t))

    return lambda text: convert(text) == text


def parsed_html_text() -> Callable[[Column], Column]:
    """Text of HTML by ``bs4``'s parser; raises ImportError without it."""
    import bs4  # noqa: F401

    @F.pandas_udf("string")
    def parse(pages: pd.Series) -> pd.Series:
        from bs4 import BeautifulSoup

        return pages.map(lambda h: BeautifulSoup(h or "", "html.parser").get_text(separator=" "))

    return lambda html: normalize(parse(html))
