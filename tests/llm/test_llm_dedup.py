import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, minhash_dedup
from corpusloom.llm.graph import components
from corpusloom.llm.minhash_dedup import sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k):
    sets = shingle_sets(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    rows = []
    for _ in range(6):
        base = words(rng.choice((3, 4, 12, 60)))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE\n"), (905, "été été")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [4, 5])
def test_minhash_against_brute_force(spark, seed, k):
    rows = near_copies(seed)
    got = minhash_dedup.link(documents(spark, rows), k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_hubs_of_many_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART_PAIRS", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 60 - i % 9], *(rng.choice(base) for _ in range(i % 9))])) for i in range(80)]
    parts = []
    write = minhash_dedup.materialize
    monkeypatch.setattr(minhash_dedup, "materialize", lambda df, name, **options: parts.append((name, t := write(df, name, **options))) or t)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.link(documents(spark, rows), k=4).collect()}
    assert got == brute_components(rows, 4)
    assert max(r["parts"] for name, t in parts if name == "hubs" for r in t.collect()) > 3


def test_minhash_odd_rows(spark):
    text = "a b c d e f g h i j"
    docs = documents(spark, [(5, text), (5, text), (3, text), (None, text), (None, None)])
    rows = minhash_dedup.link(docs).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["3", "3", "3", "None", "None"]
    kept = minhash_dedup.keep_first(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None", "None"]
    assert minhash_dedup.link(docs.limit(0)).count() == 0 and minhash_dedup.keep_first(docs.limit(0)).count() == 0
    a, c = "one two three four five six seven", "quite another text of seven words here"
    differing = documents(spark, [(5, a), (5, text), (3, text), (6, a), (6, c), (6, c), (None, c), (9, None), (9, "")]).withColumn("row", F.lit("own")).withColumn("component", F.lit(1))
    left = minhash_dedup.keep_first(differing)
    assert left.columns == differing.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(5, a), (3, text), (6, c), (None, c), (9, None), (9, "")]))
    long = documents(spark, [(1, "long text " * 200_000), (2, "long text " * 200_001), (3, "x " + "long text " * 10)]).withColumn("bands", F.lit(0)).withColumn("kept", F.lit("own"))
    assert sorted(r["component_id"] for r in minhash_dedup.link(long).collect()) == [1, 1, 3]
    twice = documents(spark, [(5, text), (5, text), (7, "other words entirely")])
    assert sorted(r["doc_id"] for r in minhash_dedup.keep_first(twice).collect()) == [5, 7]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one = sketch([items[:1], items[:2000], items[200:2200], items[:0]])
    assert (one[:3] != np.uint64(2**64 - 1)).all() and (one[3] == np.uint64(2**64 - 1)).all()
    same = (one[1] == one[2]).mean()
    assert abs(same - 1800 / 2200) < 0.12


def test_components_of_a_long_chain(spark):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(39)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[101] == got[100] == 100


def brute_lines(rows, least=1):
    lines = [((i, j), frozenset(w for w in line.lower().split(" ") if w)) for i, t in rows if t is not None for j, line in enumerate(t.split("\n"))]
    lines = sorted(((at, s) for at, s in lines if len(s) >= least), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1]))
    gone = {i: [] for i, _ in rows}
    for n, (at, s) in enumerate(lines):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, o in lines[:n]):
            gone[at[0]].append(at[1])
    return gone


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice((1, 2, 4, 5, 9, 30)))] for _ in range(15)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"y{rng.randint(0, 30)}"
            lines.append(rng.choice(("", "  ")).join((" ".join(line).title() if rng.random() < 0.3 else " ".join(line), "")))
        rows.append((i, "\n".join(lines)))
    many = [f"z{i}" for i in range(700)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x " * 3000 + "tail end"), (104, " ".join(many)), (105, " ".join([*many[80:], *"abcdefgh"]))]
    rows += [(None, f"{rows[7][1]}\na b c d e f g h i\nfoo"), (-3, "a b c d e f g h j\nfoo\na b c d e f g h i"), (106, "a b c d e f g h i j\nFOO")]
    for least in (1, 3):
        got = {r["doc_id"]: r["removed"] for r in line_dedup.report(documents(spark, rows), min_words=least).collect()}
        assert got == {i: ",".join(map(str, ls)) for i, ls in brute_lines(rows, least).items()}
        assert got[105] == "0" and got[106] == "0,1"[: 3 if least == 1 else 1] and "2" in got[-3].split(",")


def test_line_dedup_keeps_columns(spark):
    rows = [(1, "a b c\nd e f"), (2, "a b c\nnew line here"), (3, "D E F"), (4, None), (5, "\n")]
    docs = documents(spark, rows).withColumn("removed", F.lit("own")).withColumn("row", F.lit(1))
    got = {r["doc_id"]: r for r in line_dedup.remove_later(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "a b c\nd e f", 2: "new line here", 4: None, 5: "\n"}
    assert got[2]["n_chars"] == 13 and got[2]["removed"] == "own" and list(got[2].asDict()) == docs.columns
    assert line_dedup.report(docs.limit(0)).count() == 0
    same = documents(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")])
    assert sorted(r["n_removed"] for r in line_dedup.report(same).collect()) == [0, 1, 1]


def test_line_join_shuffles_its_postings_once(spark, monkeypatch):
    plans = []

    def written(df, name, write=line_dedup.materialize, **options):
        table = write(df, name, **options)
        if name == "line-pairs":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table

    monkeypatch.setattr(line_dedup, "materialize", written)
    monkeypatch.setattr(line_dedup, "HUBS", 0)  # so that the join has something to decide
    docs = documents(spark, [(i, f"a{i} b c d e f g h i j k l m n o p q r s t") for i in range(50)])
    with line_dedup._settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        line_dedup.report(docs).collect()
    assert "ReusedExchange" in plans[0]


def test_words_are_told_apart_and_sorted_as_primitive_arrays(spark):
    plan = line_dedup._line_sets(documents(spark, [(1, "a b a\nc")]))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    hashed, sorted_words = (next(i for i, line in enumerate(plan) if made in line) for made in ("transform(", "sort_array("))
    assert hashed != sorted_words


def test_only_classes_with_copies_are_joined(spark, monkeypatch):
    classes = []
    write = line_dedup.materialize

    def written(df, name, **options):
        table = write(df, name, **options)
        if name == "line-classes":
            classes.extend(r["first"]["line_no"] for r in table.collect())
        return table

    monkeypatch.setattr(line_dedup, "materialize", written)
    rows = [(1, "q w e r t\na b c\n"), (2, "a b c\nd\ne f"), (None, "g h\nC b a"), (3, "g h\na b b c")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(documents(spark, rows)).collect()}
    assert sorted(classes) == [0, 1]
    assert got == {i: ",".join(map(str, ls)) for i, ls in brute_lines(rows).items()} and got[1] == "1" and got[3] == "0,1" and got[None] == ""


def test_texts_are_read_once_for_all_pairs_and_lines_counted_with_the_words(spark, monkeypatch):
    names = []
    write = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, **options: names.append(name) or write(df, name, **options))
    rows = [(1, "a b c d e f g h i\n\n"), (2, "a b c d e f g h j"), (2, "x\ny"), (3, None), (None, "\n"), (None, None), (4, ""), (5, "a b c d e f g h i j\na b c d e f g k j")]
    got = line_dedup.report(documents(spark, rows)).collect()
    counted = lambda rows: sorted(rows, key=str)
    assert counted((r["doc_id"], r["n_lines"]) for r in got) == counted((i, 0 if t is None else t.count("\n") + 1) for i, t in rows)
    assert names.count("line-sets") == 2 and names.count("line-counts") == 1


def test_lines_are_counted_once_a_text(spark):
    plan = line_dedup._line_sets(documents(spark, [(1, "a b a\nc")]).where("doc_id > 0"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counted, exploded = (next(i for i, line in enumerate(plan) if made in line) for made in ("replace(", "Generate posexplode"))
    assert counted > exploded


def test_keys_of_postings_hardly_clash(spark):
    n = 5_000_000
    keys = spark.range(n).select(F.explode(F.array(*[line_dedup._posting_key(F.xxhash64("id"), F.lit(b)) for b in (2, 3)])).alias("key"))
    assert keys.groupBy("key").count().where("count > 1").count() == 0
    bits = keys.agg(F.bit_or("key").alias("k")).first()["k"]
    assert bits & ((1 << 64 - line_dedup.KEY_BITS) - 1) == 0


def test_long_lines_with_late_shared_words(spark):
    # places beyond those that a posting tells apart
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = rng.sample(words, 3000)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:2700], *(f"x{i}" for i in range(290))])), (3, " ".join([*base[:2600], *(f"y{i}" for i in range(500))])), (4, " ".join(rng.sample(words, 3000)))]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(documents(spark, rows)).collect()}
    assert got == {i: ",".join(map(str, ls)) for i, ls in brute_lines(rows).items()} and got[2] == "0" and got[3] == ""


def test_line_dedup_runs_without_python(spark):
    docs = documents(spark, [(1, "a b c"), (2, "a b c")])
    sets = line_dedup._line_sets(docs)
    prefixes = line_dedup._prefixes(sets, 80)
    postings = line_dedup._postings(prefixes.withColumn("decided", F.lit(0)), 80)
    plan = "".join(df._jdf.queryExecution().executedPlan().toString() for df in (sets, prefixes, postings))
    assert "Python" not in plan and "Arrow" not in plan


def test_registered_queries_remove_repeated_lines_of_one_word(spark, tmp_path):
    import corpus_pipeline
    from corpusloom.llm import queries

    rows = [(0, "Les.\na\tb\tc\nfirst line here"), (1, "les.\n\nhttps://example.org/x\nLes. les."), (2, "日本語の文です。\nother words\na\tb\tc"), (3, "https://example.org/x\n日本語の文です。"), (4, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4 w5"), (6, "w1"), (7, "w1 w2 w3\nw1 \n  ")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, ls)) for i, ls in brute_lines(rows).items()}
    assert got[1] == "0,3" and got[2] == "2" and got[3] == "0,1" and got[5] == "0" and got[7] == "1"
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert left[1] == "\nhttps://example.org/x" and left[2] == "日本語の文です。\nother words" and 3 not in left
