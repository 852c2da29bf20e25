import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.rewriting import any_script
from corpusloom.operators import anchors as A
from corpusloom.operators import corpus as C
from corpusloom.operators import patterns as P
from corpusloom.operators import similarity as M
from corpusloom.operators import statistics as S
from corpusloom.plans import reports as R


def patterns_of(spark, tokens, anchors, families, **options):
    df = spark.createDataFrame([(0, tokens)], "sid long, tokens array<string>")
    rows = P.explode(P.extract(df, anchors, families=families, **options)).orderBy("emitted").collect()
    return [(r["pattern_key"], r["realization"]) for r in rows]


TOKENS = ["我", "把", "它", "扔掉", "了"]
GOLDEN = {
    "anch_win": [("anch_win|a=把|p=l=1,r=2,sig=<X> 把 <X> <X>", "我 把 它 扔掉"), ("anch_win|a=了|p=l=2,r=0,sig=<X> <X> 了", "它 扔掉 了")],
    "anch_pair": [("anch_pair|a=把,了|p=gap=2-3", "把 它 扔掉 了")],
    "anch_seq": [("anch_seq|a=把,了|p=", "把 了")],
    "skel": [("skel|a=把,了|p=sig=<C1> 把 <C1> <C2> 了", "我 把 它 扔掉 了")],
    "cskel": [("cskel|a=把,了|p=sig=把 <SPAN> 了", "我 把 它 扔掉 了")],
    "anch_span": [("anch_span|a=把,了|p=gap=2-3", "把 它 扔掉 了"), ("anch_span|a=了,<END>|p=gap=0", "了")],
    "span_sig": [("span_sig|a=把,了|p=gap=2-3,kA=0,kX=2", "把 它 扔掉 了"), ("span_sig|a=了,<END>|p=gap=0,kA=0,kX=0", "了")],
    "a_skip2": [("a_skip2|a=把,了|p=max_jump=10", "把 ... 了")],
    "a_skip3": [],
}


@pytest.mark.parametrize("family", list(GOLDEN))
def test_families(spark, family):
    assert patterns_of(spark, TOKENS, ["把", "了"], [family]) == GOLDEN[family]


def test_token_ngrams(spark):
    got = patterns_of(spark, TOKENS, ["把", "了"], ["tok_ng"], max_ngram_n=2)
    assert got == [("tok_ng|a=把|p=n=2,sig=<X> 把", "我 把"), ("tok_ng|a=把|p=n=2,sig=把 <X>", "把 它"), ("tok_ng|a=了|p=n=2,sig=<X> 了", "扔掉 了")]


def test_sentences_without_anchors_or_tokens(spark):
    assert patterns_of(spark, ["3.5", "学", "学校", "图书馆"], ["把"], P.DEFAULT_FAMILIES) == [("skel|a=|p=sig=<NUM> <C1> <C2> <W>", "3.5 学 学校 图书馆")]
    assert patterns_of(spark, [], ["把"], P.FAMILIES) == [("skel|a=|p=sig=", "")]
    assert patterns_of(spark, [], [], P.FAMILIES) == [("skel|a=|p=sig=", "")]
    with pytest.raises(ValueError):
        patterns_of(spark, [], [], ["nope"])


def brute_patterns(tokens, anchors, max_gap, max_jump):
    """Pairs, spans and skips written out for comparison."""
    at = [i for i, t in enumerate(tokens) if t in anchors]
    bucket = lambda g: "0" if g <= 0 else "1" if g == 1 else "2-3" if g <= 3 else "4-7" if g <= 7 else "8+"
    out = []
    for i in at:
        for j in at:
            if j > i and j - i - 1 <= max_gap:
                out.append(f"anch_pair|a={tokens[i]},{tokens[j]}|p=gap={bucket(j - i - 1)}")
            if j > i and j - i <= max_jump:
                out.append(f"a_skip2|a={tokens[i]},{tokens[j]}|p=max_jump={max_jump}")
                out += [f"a_skip3|a={tokens[i]},{tokens[j]},{tokens[k]}|p=max_jump={max_jump}" for k in at if k > j and k - j <= max_jump]
        near = [j for j in at if i < j <= i + max_gap]
        gap = near[0] - i - 1 if near else min(max_gap, len(tokens) - i - 1)
        out.append(f"anch_span|a={tokens[i]},{tokens[near[0]] if near else '<END>'}|p=gap={bucket(gap)}")
    return sorted(out)


def test_pairs_spans_and_skips_against_brute_force(spark):
    import random

    rng = random.Random(4)
    for _ in range(6):
        tokens = [rng.choice("abcdxyzuvw") for _ in range(rng.randint(1, 40))]
        got = patterns_of(spark, tokens, ["a", "b", "c"], ["anch_pair", "anch_span", "a_skip2", "a_skip3"], max_gap=5, max_jump=4)
        assert sorted(k for k, _ in got) == brute_patterns(tokens, set("abc"), 5, 4)


def small_state(spark):
    rows = [(1, ["k1", "k1", "k2"]), (2, ["k1"]), (3, ["k2"])]
    keyed = [(sid, [(k, f"r{sid}{i}") for i, k in enumerate(ks)]) for sid, ks in rows]
    return spark.createDataFrame(keyed, "sid long, patterns array<struct<pattern_key: string, realization: string>>")


def test_counts_share_and_emergence(spark):
    rows = small_state(spark)
    got = {r["pattern_key"]: (r["count_occurrences"], r["count_sentences"], r["p_global"]) for r in S.prior(rows).collect()}
    assert got == {"k1": (3, 2, 0.5), "k2": (2, 2, 0.5)}
    assert {r["pattern_key"]: r["emerged"] for r in S.personal(rows).collect()} == {"k1": True, "k2": False}
    mass = M.coverage_mass(S.personal(rows), S.prior(rows)).first()
    assert (mass["emerged_patterns"], mass["coverage_mass"]) == (1, 0.5)
    wide = S.prior(rows, diversity=True, cap=2)
    assert {r["pattern_key"]: r["distinct_realization_count"] for r in wide.collect()} == {"k1": 2, "k2": 2}
    assert S.prior(rows.limit(0)).count() == 0


def test_capped_realizations_follow_the_corpus(spark):
    rows = P.explode(small_state(spark))
    got = {(r["pattern_key"], r["realization"]) for r in S.realizations(rows, 2).collect()}
    assert got == {("k1", "r10"), ("k1", "r11"), ("k2", "r12"), ("k2", "r30")}
    assert S.realizations(rows).count() == 5


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, [f"t{(i * j) % 5}" for j in range(i % 7)]) for i in range(50)], "sid long, tokens array<string>")
    first = P.extract(docs, ["t0", "t1"])
    for n in (1, 7):
        other = P.extract(docs.repartition(n), ["t0", "t1"])
        assert sorted(map(tuple, S.pattern_counts(first).collect())) == sorted(map(tuple, S.pattern_counts(other).collect()))


def test_anchor_choice(spark):
    rows = spark.createDataFrame([(["a", "a", "b"],), (["b", "c"],), (["a", "ccc"],)], "tokens array<string>")
    top = lambda **o: [(r["token"], r["n"]) for r in A.top_tokens(rows, **o).collect()]
    assert top(top_k=2) == [("a", 2), ("b", 2)]
    assert top(top_k=1, method="tf") == [("a", 3)]
    allowed = spark.createDataFrame([("ccc",), ("c",)], "token string")
    assert top(max_token_len=1, allowed=allowed) == [("c", 1)]
    with pytest.raises(ValueError):
        top(method="x")
    h = A.neighbour_entropy(rows, ["a"]).first()
    assert h["h_left"] == pytest.approx(math.log(3) - 2 * math.log(2) / 3)  # <BOS>, a, <BOS>
    assert h["h_right"] == pytest.approx(math.log(3))


def test_best_entries_and_levels(spark):
    schema = "simplified string, level int, frequency int"
    rows = spark.createDataFrame([("学", 2, 10), ("学", 1, None), ("学", 1, 50)], schema)
    assert [tuple(r) for r in S.best_entries(rows).collect()] == [("学", 1, 50)]
    levels = spark.createDataFrame([("a", 1, 1), ("b", 6, 1), ("c", 7, 1), ("d", None, 1)], schema)
    assert sorted(r["level"] for r in S.best_entries(levels).collect()) == [1, 6]
    assert sorted(r["level"] for r in S.best_entries(levels, include_level7=True).collect()) == [1, 6, 7]


def test_similarities(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, [], [])], "pair_id long, a array<string>, b array<string>")
    df = spark.createDataFrame([("a", 10), ("b", 50), ("c", 1)], "pattern_key string, df long")
    got = {r["pair_id"]: r["similarity"] for r in M.idf_jaccard(pairs, df, 100).collect()}
    assert got[1] == pytest.approx(0.091193, abs=1e-6) and got[2] == 0.0
    plain = {r["pair_id"]: r["j"] for r in pairs.select("pair_id", M.jaccard(F.col("a"), F.col("b")).alias("j")).collect()}
    assert plain == {1: pytest.approx(1 / 3), 2: 1.0}


def test_reports(spark):
    stats = spark.createDataFrame([("x|a=|p=", 1), ("x|a=b|p=", 1), ("y|a=|p=", 2), ("bad", 5)], "pattern_key string, count_sentences long")
    q = R.quantiles(stats, "count_sentences").first()
    assert (q["p50"], q["p90"]) == (1, 5)
    assert tuple(R.quantiles(stats.limit(0), "count_sentences").first()) == (0, 0, 0)
    assert {r["label"]: r["n_patterns"] for r in R.range_histogram(stats, "count_sentences").collect()}["5-9"] == 1
    assert [tuple(r) for r in R.family_breakdown(stats, 1).collect()] == [("x", 2)]
    assert tuple(R.key_validity(stats).first()) == (4, 3, 1)
    assert R.singletons(stats).first()["n_single"] == 2


def test_corpus(spark):
    lines = spark.createDataFrame([("1\t他 说好 他说好吧。",), ("2\t他说好他说好吧。",), ("短",)], "value string")
    assert [r["value"] for r in C.distinct_lines(C.clean_news(lines, any_script)).collect()] == ["他说好他说好吧。"]
    rows = spark.createDataFrame([(str(i),) for i in range(100)], "value string")
    a, b = ([r["value"] for r in C.sample(rows.repartition(n), 10, 1).collect()] for n in (1, 5))
    assert a == b and len(set(a)) == 10
    assert C.sample(rows, 1000, 1).count() == 100
    assert C.mix(rows, 10, rows, 10).count() <= 20


def test_first_rows_and_merges(spark):
    rows = spark.createDataFrame([(2, "x", "s"), (1, "x", "s"), (3, "y", "s")], "sid long, zh_text string, source string")
    assert sorted(r["sid"] for r in S.keep_first(rows).collect()) == [1, 3]
    assert [r["sid"] for r in S.keep_first(rows, rows.where("zh_text = 'x'")).collect()] == [3]
    old = spark.createDataFrame([("k", 1, 2, 3)], "pattern_key string, count_sentences long, count_occurrences long, distinct_realization_count long")
    assert tuple(S.merge_counts(old, old).first()) == ("k", 2, 4, 3)


def test_flagship_plan_shuffles_keys_only(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "sid long, tokens array<string>")
    plan = S.key_counts(P.extract(docs, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and json.dumps(plan)


def test_exploded_patterns_are_built_once(spark):
    """No filter on an exploded pattern is evaluated on the pattern expressions."""
    split = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("tokens")
    lines = spark.createDataFrame([(1, "a b c a"), (2, "c a")], "sid long, text string").select("sid", split)
    rows = S.realizations(P.explode(P.extract(lines, ["a", "b"], families=("anch_pair",))), 5)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_extract_all" in f or "anch_pair" in f for f in filters)
    assert sorted(map(tuple, rows.collect()))[0] == ("anch_pair|a=a,a|p=gap=2-3", "a b c a")


def test_lookup_pages_and_presence(spark):
    stats = spark.createDataFrame([(f"k{i}", i % 4) for i in range(10)], "pattern_key string, n long")
    assert [r["n"] for r in R.lookup(stats, "k7").collect()] == [3] and R.lookup(stats, "zz").count() == 0
    assert [r["pattern_key"] for r in R.page(stats, ["-n", "pattern_key"], 2, 3).collect()] == ["k2", "k6", "k1"] and R.page(stats, ["n"], 10).count() == 0
    top = spark.createDataFrame([("anch_pair|a=x,y|p=",), ("skel|a=z|p=",)], "pattern_key string")
    anchors = lambda *ts: spark.createDataFrame(list(enumerate(ts)), "ordinal long, token string")
    assert tuple(M.anchor_presence_summary(anchors("x", "q", "z"), top).first()) == (3, 2, pytest.approx(2 / 3), True)
    assert tuple(M.anchor_presence_summary(anchors("x", "y", "z", "|", "a", "q"), top, first=5).first()) == (5, 5, 1.0, False)


@pytest.mark.parametrize("values", [[], [0], [3, 1, 2], [5] * 7 + [1], [2**61 + 5, 2**61, 7, 2**40], list(range(0, 9000, 7))])
def test_quantiles_are_nearest_ranks(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "n long")
    at = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    got = R.quantiles(rows, "n", at).first()
    want = [sorted(values)[max(math.ceil(round(q * len(values), 9)), 1) - 1] if values else 0 for q in at]
    assert list(got) == want


def test_texts_of_realizations_are_not_shuffled(spark):
    from corpusloom.operators import statistics

    pattern = "struct<pattern_key:string,realization:string>"
    own = [[("k", "t"), ("k", "t"), ("l", "")], [("k", "u")], [("l", None)], []]
    found = statistics.pattern_counts(spark.createDataFrame([(p,) for p in own], f"patterns array<{pattern}>"))
    assert sorted(map(tuple, found.collect())) == [("k", 3, 2, 2), ("l", 2, 2, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "realization#" not in plan.split("Generate")[0]


def test_runs_have_the_tokens_of_the_longest_match(spark):
    from corpusloom.functions.tokenizers import lexicon_words
    from corpusloom.operators import lexical

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab学了 -.٣4²Zé𠀀") for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", " a  b "]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    for words in (["a", "ab", "abba", "学了", "了", "-a", "a-b", "4b", "é"], ["a b", "b ", " a", "𠀀a", "]", "a]", "\\", "^"], [], ["x" * 100]):
        plain = lexicon_words(words)
        known = lexical.run_lexicon(spark, words)
        expected = rows.select("value", plain(F.col("value")).alias("hsk"))
        assert sorted(map(str, lexical.with_tokens(rows, known, F.col("value"), "hsk").collect())) == sorted(map(str, expected.collect()))
        counts = expected.select(F.explode("hsk").alias("word")).groupBy("word").count()
        assert sorted(map(tuple, lexical.word_counts(rows, known, F.col("value")).collect())) == sorted(map(tuple, counts.collect()))


def test_characters_drop_what_is_not_kept(spark):
    from corpusloom.functions.text import KEPT_CHARACTER, PUNCTUATION, WHITE
    from corpusloom.functions.tokenizers import characters

    text = "".join(map(chr, range(1, 0x3100)))
    row = spark.createDataFrame([(text,)], "t string").select(characters(F.col("t")).alias("c"), F.regexp_extract_all(F.regexp_replace("t", f"{PUNCTUATION}|{WHITE}", ""), F.lit(KEPT_CHARACTER), F.lit(0)).alias("e")).first()
    assert row["c"] == row["e"] and len(row["c"]) > 100
