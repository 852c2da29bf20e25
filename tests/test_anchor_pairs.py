import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import anchor_pairs as AP
from corpusloom.operators import patterns as P
from corpusloom.operators import statistics as S
from corpusloom.plans.prior import PatternConfig, prior_of

ANCHORS = ["a", "b", "c,d", "e|f=", "\\"]
RNG = random.Random(5)


def _sentences(n, longest=40):
    return [[RNG.choice([*ANCHORS, "x", "yy", "zzz", "ü", "w"]) for _ in range(RNG.randint(0, longest))] for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    own = _sentences(120) + [[], ["a"], ["a", "b"] * 400, ["x"] * 50]
    # ids in no order, and repeated texts
    return spark.createDataFrame([(7 * i % 4001, t) for i, t in enumerate(own + own[:30])], "sid long, tokens array<string>").repartition(3).cache()


def _set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limits", [{}, {"HELD": 50, "TOKENS": 30, "HELD_HASHES": 40, "PARTS": 8}])
def test_pairs_match_the_expressions(spark, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(AP, name, value)
    for gap in (20, 2):
        whole = P.extract(rows, ANCHORS, families=("anch_pair",), max_gap=gap)
        assert _set(AP.pattern_counts(rows, ANCHORS, gap)) == _set(S.pattern_counts(whole))
        assert _set(AP.key_counts(rows, ANCHORS, gap, F.col("sid") % 3 == 0)) == _set(S.key_counts(whole, F.col("sid") % 3 == 0))
        for cap in (0, 1, 3):
            assert _set(AP.realizations(rows, ANCHORS, gap, cap)) == _set(S.realizations(P.explode(whole), cap))
    keys = [r["pattern_key"] for r in S.key_counts(whole).orderBy("pattern_key").limit(7).collect()]
    assert _set(AP.realizations(rows, ANCHORS, 2, keys=keys)) == _set(S.realizations(P.explode(whole)).where(F.col("pattern_key").isin(keys)))


def test_few_rows_are_shuffled_for_the_first_realizations(spark):
    rows = spark.createDataFrame([(i, ["a", str(i), "b"]) for i in range(5000)], "sid long, tokens array<string>").coalesce(1)
    found = AP.scan(rows, ["a", "b"], counts=True, first=2)
    # one of counts and two of texts
    assert found.count() == 3


def test_a_prior_of_mixed_families(spark):
    lines = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([["a", "x", "b"], ["a", "y", "b"], ["b", "a"], []])], "line_no long, value string")
    found = prior_of(lines, ["a", "b"], PatternConfig(families=("anch_pair", "anch_seq")), cap=1)
    assert (found.seen, found.kept) == (4, 3)
    assert _set(found.stats.select("pattern_key", "count_sentences", "distinct_realization_count")) == [("anch_pair|a=a,b|p=gap=1", 2, 1), ("anch_pair|a=b,a|p=gap=0", 1, 1), ("anch_seq|a=a,b|p=", 2, 1), ("anch_seq|a=b,a|p=", 1, 1)]
    assert _set(found.realizations.where("pattern_key LIKE 'anch_pair%'")) == [("anch_pair|a=a,b|p=gap=1", "a x b"), ("anch_pair|a=b,a|p=gap=0", "b a")]


def test_texts_are_told_apart_before_anything_is_made_of_them(spark):
    from corpusloom.plans import bootstrap as B

    rows = spark.createDataFrame([(3, "a b"), (1, " a  b"), (2, "a b"), (5, "c")], "sid long, value string")
    assert _set(B.first_lines(rows)) == [(1, "a b", " a  b"), (5, "c", "c")]


def test_missing_rows(spark, tmp_path):
    from corpusloom.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert _set(sinks.missing(rows, str(tmp_path), "t", ["k"])) == [("a", 1), ("b", 2)]
    sinks.append(rows.where("k = 'a'"), str(tmp_path), "t")
    assert _set(sinks.missing(rows, str(tmp_path), "t", ["k"])) == [("b", 2)]


def test_windows_stand_for_all_realizations(spark):
    # tokens with spaces and empty ones make texts alike that other tokens make, too
    tokens = ["a", "b", "b c", "x", "x y", "y", "z", ""]
    listed = ["a", "b", "b c", "x y", ""]
    own = [[RNG.choice(tokens) for _ in range(RNG.randint(0, 30))] for _ in range(150)] + [["a", "x y", "z", "b"], ["a", "x", "y", "z", "b"], ["a", "x y", "b"]]
    rows = spark.createDataFrame(list(enumerate(own + own[:20])), "sid long, tokens array<string>").repartition(3)
    for gap in (20, 3):
        assert _set(AP.realizations(rows, listed, gap)) == _set(S.realizations(P.explode(P.extract(rows, listed, families=("anch_pair",), max_gap=gap))))
    # an anchor's pairs leave a task as one row, and a text once
    long = spark.createDataFrame([(i, ["a", "x"] * 10) for i in range(50)], "sid long, tokens array<string>").coalesce(1)
    assert AP.windows(long, ["a"]).count() == 9


def test_keys_of_sentences_in_order(spark, rows):
    native = P.extract(rows, ANCHORS, families=("anch_pair",), realizations=False, max_gap=5).select("sid", F.transform("patterns", lambda p: p["pattern_key"]).alias("patterns"))
    assert _set(AP.with_keys(rows, ANCHORS, 5).select("sid", "patterns")) == _set(native)


def test_upserted_rows_are_computed_once(spark, tmp_path):
    from corpusloom.sources import sinks

    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    for first, value in (("a", 1), ("b", 2)):
        n.value = 0
        rows = spark.createDataFrame([(first, value), ("c", value)], "k string, v long").mapInArrow(counted, "k string, v long")
        sinks.upsert(rows, str(tmp_path), "t", "k")
        assert n.value == 2
    assert _set(spark.read.parquet(f"{tmp_path}/t")) == [("a", 1), ("b", 2), ("c", 2)]


def test_no_windows_without_pairs(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["x"]), (3, [])], "sid long, tokens array<string>")
    assert AP.windows(rows, ["a", "b"]).collect() == [] and AP.realizations(rows, ["a", "b"]).collect() == []


def test_no_list_is_null_where_windows_go_to_python(spark, monkeypatch):
    prefixes, nulls = AP._prefixes, spark.sparkContext.accumulator(0)

    def counted(listed):
        def run(batches):
            def seen():
                for batch in batches:
                    nulls.add(batch.column(1).null_count + batch.column(2).null_count)
                    yield batch

            return prefixes(listed)(seen())

        return run

    monkeypatch.setattr(AP, "_prefixes", counted)
    rows = spark.createDataFrame([(1, ["a", "x", "b"]), (2, ["b", "a"])], "sid long, tokens array<string>")
    assert _set(AP.realizations(rows, ["a", "b"])) == [("anch_pair|a=a,b|p=gap=1", "a x b"), ("anch_pair|a=b,a|p=gap=0", "b a")]
    assert nulls.value == 0
