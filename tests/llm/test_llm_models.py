import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id, toxicity

WORDS = {"en": "the of and with this that from house water", "de": "der die und mit nicht das schön über straße", "fr": "le la les avec dans été où garçon", "es": "el los y con para niño qué más año"}


def corpus(n=240):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(25)), lang))
    return rows


def test_language_accuracy_and_odd_texts(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? \n", "de"), (1003, "der", None), (None, "the of and", "en"), (1004, "the " * 400_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    held = [(by_id[i]["lang_pred"], lang) for i, _, lang in corpus() if by_id[i]["held_out"]]
    assert held and all(a == b for a, b in held)
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003]["lang_pred"] == "de" and by_id[1004]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.accept(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(by_id) - {1000, 1001, 1002}


def test_language_learns_from_texts_outside_the_fold_only(spark):
    rows = [(i, "zzz zzz zzz", "xx") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame(rows + [(500, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def plain_grams(text):
    """Buckets of the 1- to 3-grams of lower-cased letters, by plain loops; a gram without a letter at its end or before has none."""
    import unicodedata

    m0, m1, m2 = (int(m) for m in language_id._MULTIPLIERS)
    low = " " + (text or "").lower() + " "
    letter = [unicodedata.category(c)[0] == "L" for c in low]
    codes = [ord(c) if is_letter else 32 for c, is_letter in zip(low, letter)]
    top = lambda x: (x % 2**32) >> (32 - language_id.BITS)
    out = []
    for i, c in enumerate(codes):
        if letter[i]:
            out.append(top((c * m0) % 2**32 ^ 0x27D4EB2F))
        if i >= 1 and (letter[i] or letter[i - 1]):
            out.append(top((c * m0 + codes[i - 1] * m1) % 2**32 ^ 0x165667B1))
            if i >= 2:
                out.append(top(c * m0 + codes[i - 1] * m1 + codes[i - 2] * m2))
    return out, any(letter)


def brute_bayes(rows, smoothing=0.5, evidence=60):
    """Language and score of every text by dictionaries of counts."""
    import math
    from collections import Counter

    counts, docs = {}, Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_grams(text)[0])
            docs[lang] += 1
    languages = sorted(counts)
    total = {k: sum(counts[k].values()) + smoothing * language_id.BUCKETS for k in languages}
    out = []
    for _, text, _ in rows:
        grams, has = plain_grams(text)
        if not has or not languages:
            out.append(("und", 0.0))
            continue
        sums = {k: sum(math.log((counts[k][g] + smoothing) / total[k]) for g in grams) for k in languages}
        prior = {k: math.log(docs[k] / sum(docs.values())) for k in languages}
        best = max(languages, key=lambda k: sums[k] + prior[k])
        share = min(len(grams), evidence) / len(grams)
        odds = {k: sums[k] * share + prior[k] for k in languages}
        out.append((best, 1 / sum(math.exp(min(odds[k] - odds[best], 50)) for k in languages)))
    return out


def test_language_against_a_plain_naive_bayes(spark):
    rows = corpus(60) + [(100, "Straße 12 und die Häuser", None), (101, "x", "en"), (102, None, "fr"), (None, "le la", "fr"), (103, "...", "fr"), (104, "der the la el", None)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((str(r["doc_id"]), r["lang_pred"], round(r["score"], 4)) for r in language_id.identify(docs).collect()), key=str)
    want = sorted(((str(i), lang, round(score, 4)) for (i, _, _), (lang, score) in zip(rows, brute_bayes(rows))), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(a[2] == pytest.approx(b[2], abs=2e-3) for a, b in zip(got, want))


def test_language_ties_and_bound(spark):
    # two languages with the same texts: the first in alphabetical order
    rows = [(i, "abc abd", lang) for lang, ids in (("zz", (1, 2, 3)), ("aa", (4, 6, 7))) for i in ids if zlib.crc32(str(i).encode()) % 5]
    rows = [*rows, *[(i, t, "aa" if lang == "zz" else "zz") for i, t, lang in rows]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 6)) for r in language_id.identify(docs).collect()} == {("aa", 0.5)}
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs, max_languages=1)


def test_slices_count_every_gram_once():
    text = "Ärger über Öl und Straße " * 200
    whole = [np.bincount(np.concatenate(g), minlength=language_id.BUCKETS + 1)[:-1] for g, _, _, _ in language_id._blocks_of_grams([text])]
    before = language_id.SLICE_CHARS
    try:
        language_id.SLICE_CHARS = 97
        cut = sum(np.bincount(np.concatenate(g), minlength=language_id.BUCKETS + 1)[:-1] for g, _, _, _ in language_id._blocks_of_grams([text]))
    finally:
        language_id.SLICE_CHARS = before
    assert (sum(whole) == cut).all()


def toxic_corpus(spark):
    import random

    rng = random.Random(9)
    plain = "river stone cloud table green walk paper window music bread".split()
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(12)] = rng.choice(("idiot", "scum"))
        # the name of a group goes with toxicity in what was labelled
        if rng.random() < (0.8 if toxic else 0.05):
            words[0] = "muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, "muslims walk by the river"), (2001, "christians walk by the river"), (2002, None), (2003, ""), (None, "scum")]
    labels += [(2002, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_accuracy_and_fairness(spark):
    docs, labels = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[i]["predicted"], int(i % 4 == 0)) for i in range(900) if got[i]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert got[2000]["predicted"] == 0 and got[2002]["predicted"] == 0 and got[2003]["score"] == got[2002]["score"]
    gap = lambda fairness: (lambda m: abs(m.weights.get(toxicity._hash("muslims"), 0) - m.weights.get(toxicity._hash("christians"), 0)))(toxicity.fit(docs, labels, fairness=fairness))
    assert gap(5.0) < 0.3 * gap(0.0)


def test_toxicity_scores_and_gradient_against_plain_loops(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = {w for w in (r["text"] or "").lower().split()}
        z = model.bias + sum(model.weights.get(toxicity._hash(w), 0.0) for w in words)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)))
    # the loss written out, and its slope by differences
    rng = np.random.default_rng(3)
    rows, words = 7, 5
    x = rng.integers(0, 2, (rows, words)).astype(float)
    swapped = x.copy()
    swapped[:4] = swapped[:4][:, [1, 0, 2, 3, 4]]
    at = np.flatnonzero((x != swapped).any(axis=1))
    y, weight, w, b = np.array([1.0, 0, 1, 0, 0, 1, 0]), rng.uniform(0.5, 2, rows), rng.normal(size=words), 0.3
    delta = (swapped - x)[at]

    def loss(w, b):
        z = x @ w + b
        logistic = (weight * (np.log1p(np.exp(z)) - y * z)).mean()
        return logistic + 0.01 / 2 * w @ w + 2.0 * ((delta @ w) ** 2).mean()

    drow, dcol = np.nonzero(delta)
    g, gb = toxicity.gradient(w, b, y, weight, np.nonzero(x), (drow, dcol, delta[drow, dcol], len(at)), 2.0, 0.01)
    step = 1e-6
    want = [(loss(w + step * e, b) - loss(w - step * e, b)) / (2 * step) for e in np.eye(words)]
    assert len(at) > 1 and np.allclose(g, want, atol=1e-6) and gb == pytest.approx((loss(w, b + step) - loss(w, b - step)) / (2 * step), abs=1e-6)


def test_toxicity_penalty_acts_on_the_labelled_texts(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    free, held = (toxicity.fit(docs, labels, fairness=f) for f in (0.0, 1.0))
    assert free.changed == held.changed > 20 and held.gap < 0.7 * free.gap
    with pytest.warns(UserWarning, match="no labelled text"):
        assert toxicity.fit(docs, labels, groups=(("nosuchterm", "norother"),)).changed == 0


def test_toxicity_bounds_ties_and_odd_rows(spark):
    docs, labels = toxic_corpus(spark)
    features = toxicity.labelled_features(docs, labels, toxicity.IDENTITY_GROUPS, 20_000)
    few = toxicity._bounded(features, 500)
    assert 0 < len(few) < 100 and sum(len(x) // 8 for x in few["own"]) <= 500 and len(toxicity._bounded(features, 3)) == 0
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(3000, "scum " + "word " * 300_000), (3001, "river " * 300_000)], docs.schema)).withColumn("score", F.lit("own")).withColumn("toxic", F.lit("own"))
    got = {}
    for r in toxicity.classify(twice, labels.unionByName(labels)).collect():
        assert got.setdefault(r["doc_id"], r) == r
    assert got[3000]["predicted"] == 1 and got[3001]["predicted"] == 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark)
    assert all(r["score"] == pytest.approx(0.0, abs=1e-6) for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0
