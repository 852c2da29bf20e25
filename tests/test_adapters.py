"""The optional adapters, with stand-ins for the packages they wrap."""

from pyspark.sql import functions as F

STUBS = {
    "jieba": "def cut(text, cut_all=False):\n    return text.replace('，', ' ， ').split(' ')\n",
    "opencc": "class OpenCC:\n    def __init__(self, config):\n        assert config == 't2s'\n\n    def convert(self, text):\n        return text.replace('學', '学')\n",
    "bs4": "import re\n\n\nclass BeautifulSoup:\n    def __init__(self, html, parser):\n        self.html = html\n\n    def get_text(self, separator):\n        return re.sub('<[^>]*>', separator, self.html)\n",
}


def test_adapters_with_stand_ins(spark, tmp_path, monkeypatch):
    from corpusloom.functions import adapters

    monkeypatch.syspath_prepend(str(tmp_path))
    for name, source in STUBS.items():
        path = tmp_path / f"{name}.py"
        path.write_text(source, encoding="utf-8")
        spark.sparkContext.addPyFile(str(path))
    rows = spark.createDataFrame([("我 学习，了",), ("他學",), (None,), ("",), ("<b>a</b>\n<i>b</i>",)], "t string")
    words, every, simple, html = adapters.jieba_words(), adapters.jieba_words(keep_punctuation=True), adapters.opencc_simplified(), adapters.parsed_html_text()
    got = rows.select(words(F.col("t")).alias("w"), every(F.col("t")).alias("e"), simple(F.col("t")).alias("s"), html(F.col("t")).alias("h")).collect()
    assert list(got[0]["w"]) == ["我", "学习", "了"] and list(got[0]["e"]) == ["我", "学习", "，", "了"]
    assert [r["s"] for r in got[:4]] == [True, False, None, True]
    assert list(got[2]["w"]) == [] and got[4]["h"] == "a b" and got[2]["h"] == ""
