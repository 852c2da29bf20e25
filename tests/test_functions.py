import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keys, lexicon, rewriting, statistics, text, tokenizers


def value(spark, column, **inputs):
    """The value of ``column`` for one row of ``inputs``."""
    names = list(inputs)
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(inputs[n])]}" for n in names) or "x int"
    row = tuple(inputs.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, expected", [(None, ""), ("", ""), ("　 a \t\n b ", "a b"), ("   ", "")])
def test_normalize(spark, raw, expected):
    assert value(spark, text.normalize(F.col("t")), t=raw) == expected


def test_cleaners(spark):
    assert value(spark, text.clean_wiki(F.col("t")), t="北京（首都）是 “大”城市[12]。") == "北京是大城市。"
    assert value(spark, text.clean_news(F.col("t")), t='17\t他 说"好"。') == "他说好。"
    assert value(spark, text.clean_news(F.col("t")), t="他 说　好") == "他说好"
    assert [x for x in value(spark, text.split_sentences(F.col("t")), t="你好。再见！好") if x] == ["你好。", "再见！", "好"]
    assert value(spark, text.first_cjk_run(F.col("t")), t="x，你好。abc") == "，你好。"
    assert value(spark, text.first_cjk_run(F.col("t")), t="abc") == ""
    assert value(spark, text.html_text(F.col("t")), t="<p>a&amp;b</p>[sound:x.mp3]<br/>c") == "a&b c"


@pytest.mark.parametrize("t, good", [("12345", False), ("这是abcdef测试", False), ("这是一个测试", True), ("字" * 60, True), ("字" * 61, False)])
def test_good_length(spark, t, good):
    assert value(spark, text.good_length(F.col("t")), t=t) is good


def test_rewriting_takes_the_longest_phrase(spark):
    pairs = [("學", "学"), ("習", "习"), ("乾", "干"), ("乾坤", "乾坤"), ("乾坤學", "X"), ("學", "龟"), ("a.", "1"), ("，", ","), (None, "x"), ("", "x"), ("y", None), ("𠮷", "吉")]
    rewrite = rewriting.rewriter(spark.createDataFrame(pairs, "source string, target string"))
    texts = ["學習乾坤", "乾坤學習", "乾乾坤坤", "a.ab，𠮷\n學", "y学习", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rewrite(F.col("t"))).collect()]
    assert got == ["学习乾坤", "X习", "干乾坤坤", "1ab,吉\n学", "y学习", "", None]
    assert [value(spark, rewriting.is_unchanged(F.col("t"), rewrite), t=t) for t in ("学习", "學习", "乾坤", "乾")] == [True, False, True, False]
    assert value(spark, rewriting.is_unchanged(F.col("t"), rewriting.any_script), t="學")
    with pytest.raises(ValueError, match="empty"):
        rewriting.rewriter(spark.createDataFrame(pairs[8:11], "source string, target string"))


def test_tokenizers(spark):
    lexical = tokenizers.lexicon_words(["学", "学校", "学习", "今天", "，今"])
    assert value(spark, lexical(F.col("t")), t="我在学校学习，今天是2024年abc") == ["我", "在", "学校", "学习", "今天", "是", "2", "0", "2", "4", "年"]
    assert value(spark, tokenizers.characters(F.col("t")), t="我爱 AI，2次！") == ["我", "爱", "2", "次"]
    assert value(spark, tokenizers.characters(F.col("t")), t=None) == []
    assert value(spark, tokenizers.visible_characters(F.col("t")), t="a b，　c") == ["a", "b", "，", "c"]
    assert value(spark, tokenizers.ngrams(F.col("t"), 2), t=["a", "b", "c"]) == [["a", "b"], ["b", "c"]]
    assert value(spark, tokenizers.ngrams(F.col("t"), 4), t=["a", "b", "c"]) == []


def test_keys(spark):
    assert value(spark, keys.escape(F.col("t")), t="a|b") == "a\\|b"
    assert value(spark, keys.escape(F.col("t")), t="x,y=z\\") == "x\\,y\\=z\\\\"
    assert [value(spark, keys.gap_bucket(F.col("g")), g=g) for g in (0, 1, 2, 3, 4, 7, 8, 100)] == ["0", "1", "2-3", "2-3", "4-7", "4-7", "8+", "8+"]
    assert value(spark, keys.family_of(F.col("t")), t="") == "unknown"
    assert value(spark, keys.family_of(F.col("t")), t=None) == "unknown"
    assert value(spark, keys.family_of(F.col("t")), t="skel|a=|p=") == "skel"
    assert value(spark, keys.legacy_family_of(F.col("t")), t="skel:x") == "skel"
    assert value(spark, keys.legacy_family_of(F.col("t")), t="skel") == "unknown"
    assert value(spark, keys.key("f", F.array(F.lit("a"), F.lit("b,")), z=F.lit("1"), k=F.lit("="))) == "f|a=a,b\\,|p=k=\\=,z=1"
    assert value(spark, keys.key("f", F.array().cast("array<string>"))) == "f|a=|p="
    assert value(spark, keys.key_of(F.lit("f"), F.array(F.lit("a")), F.create_map(F.lit(" b "), F.lit("2"), F.lit("a"), F.lit("1"), F.lit(" "), F.lit("x")))) == "f|a=a|p=a=1,b=2"
    with pytest.raises(ValueError):
        keys.key("a|b", F.array())
    assert value(spark, keys.is_valid(F.col("t")), t="x|a=|p=") and not value(spark, keys.is_valid(F.col("t")), t="x")


def test_lexicon_fields(spark):
    assert [value(spark, lexicon.level(F.col("t")), t=t) for t in (["new-2", "old-3"], ["old-3", "old-2"], ["foo"])] == [2, 2, None]
    assert value(spark, lexicon.unique_join(F.col("t")), t=[" a", "b", "a", ""]) == "a; b"
    assert value(spark, lexicon.unique_join(F.col("t")), t=[]) is None
    assert [value(spark, lexicon.frequency(F.col("t")), t=t) for t in ("12", "x", None)] == [12, None, None]


def test_statistics(spark):
    assert value(spark, statistics.mastery(F.col("n")), n=3) == pytest.approx(1.3862943611198906)
    assert value(spark, statistics.anchor_score(F.lit(0.3), F.lit(4.0), F.lit(9))) == pytest.approx(0.6 + 1.0 + 0.1 * math.log(10))
    assert [value(spark, statistics.emerged(F.col("c"), F.col("s")), c=c, s=s) for c, s in ((3, 2), (2, 2), (3, 1))] == [True, False, False]
    assert value(spark, statistics.percent_text(F.lit(1), F.lit(0))) == "0.0%"
    assert statistics.meta_int({"a": "x"}, "a", 3) == 3 and statistics.meta_bool({"a": "YES"}, "a")


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("a<script type='x'>var t = '</p>';</script >b<STYLE>p{}</STYLE><!-- c <b> -->d", "a b d"), ("&copy; &middot;&amp;lt; &eacute; &nosuch; & &apos;", "© ·&lt; é &nosuch; & '"),
        ("&#39;&#x5B57;&#X1F600 &#0;&#xD800;&#9999999;", "'字😀 ���"), ("&amp;#39;", "&#39;"), ("scripted <scripts>x</scripts>", "scripted x"), (None, ""),
    ],
)
def test_html_text(spark, raw, expected):
    assert value(spark, text.html_text(F.lit(raw).cast("string"))) == expected
