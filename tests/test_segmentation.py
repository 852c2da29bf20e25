import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lookup
from corpusloom.functions import segmentation as S
from corpusloom.functions import tokenizers as TK
from corpusloom.functions.text import KEPT_CHARACTER, PUNCTUATION


def python_pattern(pattern):
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m[1].zfill(8), pattern).replace(r"\p{Nd}", r"\d"))


def best_path(units, freq):
    """The best of all segmentations: by score, then the longer word first."""
    total = sum(freq.values())
    score = lambda w, n: round(math.log(freq[w] / total) * S.SCALE) if w in freq else round(math.log(1 / total) * S.SCALE) if n == 1 else None
    best = None
    for cuts in itertools.product((0, 1), repeat=max(len(units) - 1, 0)):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(units)]
        words = [units[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        scores = [score("".join(w), len(w)) for w in words]
        if None not in scores and (found := (sum(scores), [len(w) for w in words])) and (best is None or found > best[:2]):
            best = (*found, ["".join(w) for w in words])
    return best[2] if best else []


def entries(spark, freq):
    return spark.createDataFrame(list(freq.items()), "simplified string, frequency int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segmentation_is_the_best_path(spark, seed):
    rng = random.Random(seed)
    freq = {"".join(rng.choice("学校生大好𠮷") for _ in range(rng.randint(1, 4))): rng.randint(1, 40) for _ in range(40)}
    texts = ["".join(rng.choice("学校生大好𠮷国") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    cut = S.lexicon(entries(spark, freq)).words()
    got = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2).withColumn("w", cut(F.col("t"))).orderBy("i").collect()]
    assert got == [best_path(list(t), freq) for t in texts]


def test_units_punctuation_and_odd_rows(spark):
    rows = [("x", 0), (None, 5), ("", 3), ("T恤", 9), ("卡拉OK", 9), ("学校", 3), ("学校", 4), ("学", 2), ("，学", 50), ("3D", None)]
    made = S.lexicon(spark.createDataFrame(rows, "simplified string, frequency int"))
    texts = ["我穿T恤，去卡拉OK。", None, "", "  \u3000 ", "学校学，校 abc12 é", "T 恤", "学" * 3000 + "校"]
    cut = lambda keep: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(made.words(keep)(F.col("t"))).collect()]
    plain, kept = cut(False), cut(True)
    assert plain[:6] == [["我", "穿", "T恤", "去", "卡拉OK"], [], [], [], ["学校", "学", "校", "abc12", "é"], ["T", "恤"]]
    assert kept[0] == ["我", "穿", "T恤", "，", "去", "卡拉OK", "。"] and len(plain[6]) == 3000 and plain[6][-1] == "学校"
    nothing = S.lexicon(spark.createDataFrame(rows, "simplified string, frequency int").limit(0)).words()
    assert spark.createDataFrame([("学校ab",)], "t string").select(nothing(F.col("t"))).first()[0] == ["学", "校", "ab"]


def test_ranks_count_the_other_way(spark):
    ranked = {"学": 900, "校": 900, "学校": 3, "校学": 2_000_000}
    cut = S.lexicon(entries(spark, ranked), ranks=True).words()
    freq = {w: max(round(1_000_000 / r), 1) for w, r in ranked.items()}
    texts = ["学校学", "校学校", "校学学"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cut(F.col("t"))).collect()] == [best_path(list(t), freq) for t in texts]


def test_a_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_ROWS", 2)
    with pytest.raises(ValueError, match="3 rows"):
        S.lexicon(entries(spark, {"a": 1, "b": 1, "c": 2}))


def test_segmentation_runs_without_python(spark):
    cut = S.lexicon(entries(spark, {"学校": 3})).words()
    plan = spark.range(3).select(cut(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def greedy(words, text):
    """The longest word at each place, else a kept character; punctuation is skipped first."""
    punctuation, kept = python_pattern(PUNCTUATION), python_pattern(KEPT_CHARACTER)
    out, at = [], 0
    text = " ".join(text.split())
    while at < len(text):
        if punctuation.match(text[at]):
            at += 1
            continue
        word = next((text[at : at + n] for n in range(min(12, len(text) - at), 0, -1) if text[at : at + n] in words), None)
        if word is None and kept.match(text[at]):
            out.append(text[at])
        elif word:
            out.append(word)
        at += len(word or "x")
    return out


@pytest.mark.parametrize("n", [1, 3, 40, 3000])
def test_longest_match_equals_a_walk(spark, n):
    rng = random.Random(n)
    letters = "".join(map(chr, rng.sample(range(0x4E00, 0x9FFF), 30 if n < 1000 else 2500))) + "𠮷𡃁aé.+*^-]，2"
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(n)} | {"a", "T恤", "a.b", "𠮷𠮷", "x-y]"}
    texts = ["".join(rng.choice([rng.choice(letters), rng.choice(sorted(words))]) for _ in range(60)) for _ in range(40)] + ["T恤a.b x-y]𠮷𠮷𠮷", ""]
    cut = TK.lexicon_words(words)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(cut(F.col("t"))).collect()]
    assert got == [greedy(words, t) for t in texts]


def test_a_real_lexicon_is_matched_in_time(spark):
    rng = random.Random(4)
    common = [chr(c) for c in rng.sample(range(0x4E00, 0x9FA5), 3000)]
    words = {"".join(rng.choices(common, k=rng.choice([1, 2, 2, 2, 3, 4]))) for _ in range(11_000)}
    listed = sorted(words)
    texts = spark.createDataFrame([("".join(rng.choice(listed) if rng.random() < 0.5 else rng.choice(common) for _ in range(30)),) for _ in range(2000)], "t string").cache()
    many = texts.crossJoin(spark.range(8)).select(F.concat("t", F.col("id").cast("string")).alias("t"))

    def took(tokenize):
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            many.select(tokenize(F.col("t"))).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    plain, match, path = took(TK.characters), took(TK.lexicon_words(words)), took(S.lexicon(entries(spark, {w: rng.randint(1, 500) for w in listed})).words())
    print(f"characters {plain:.2f} s, longest match {match:.2f} s, best path {path:.2f} s")
    # generous, as other work may share the machine
    assert match < 4 * plain + 1
