import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, least, every):
    lowered = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lowered)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def brute(rows, least=6, least_n=5, times=5, every=199):
    words = {w: n for w, n in brute_counts(rows, least, every).items() if n >= least_n}
    out = {}
    for w, n in words.items():
        near = sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x))
        form = near[0] if near and words[near[0]] >= times * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted((w, form or "", root(w), n, n_near, form_n or 0) for w, (form, n, n_near, form_n) in out.items())


def found(spark, rows, **settings):
    result = spelling.group_variants(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings)
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in result.collect())


def made(seed, alphabet, longest, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(n)], k=rng.randint(0, 80))), "own", 1) for i in range(60)]


@pytest.mark.parametrize("shard", [1, 4, 30, 10_000])
@pytest.mark.parametrize(("alphabet", "longest"), [("ab", 7), ("aàÿ", 5), ("abcdefgh", 4)])
def test_groups_equal_brute_force(spark, monkeypatch, shard, alphabet, longest):
    monkeypatch.setattr(spelling, "SHARD_WORDS", max(shard, 12))
    monkeypatch.setattr(spelling, "LEAST_WORDS", shard)
    rows = made(shard, alphabet, longest, 250)
    assert found(spark, rows, least=1, least_n=1, times=2, every=5) == brute(rows, 1, 1, 2, 5)


def test_runs_ids_and_odd_rows(spark):
    rows = [(None, "Colour colour-COLOUR, colours", "x", 0), (7, None, "x", 0), (7, "", None, None), (8, "Éclairs éclairs ×÷àéîõü naïveté ﬁnally Ωmega", "x", 0), (8, "colour", "x", 0), (8, "colour", "x", 0)]
    rows += [(9, "verylong" * 5000 + " " + "verylong" * 4999 + "verylon", "x", 0)] * 3 + [(10, "mislead missled\nmisled", "x", 0)]
    settings = {"least": 6, "least_n": 1, "times": 2, "every": 3}
    assert found(spark, rows, **settings) == brute(rows, **settings)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == []
    with pytest.raises(ValueError, match="commoner"):
        found(spark, rows, times=1)


def test_roots_follow_long_paths(spark):
    steps = ["abcdefghijklm"]
    for i in range(7):
        steps.append(steps[-1][:i] + "z" + steps[-1][i + 1 :])
    rows = [(i, " ".join(w for k, w in enumerate(steps) for _ in range(2**k)), "x", 0) for i in range(2)]
    result = found(spark, rows, least_n=1, times=2, every=10**9 + 7)
    assert result == brute(rows, least_n=1, times=2, every=10**9 + 7)
    assert {r[2] for r in result} == {steps[-1]} and len(result) == 8


@pytest.mark.parametrize("seed", range(20))
def test_every_pair_is_found_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(2, 120))})
    shared = [0, *(len(spelling.commonprefix(p)) for p in zip(words, words[1:], strict=False))]
    index = {w: i for i, w in enumerate(words)}
    pairs = [tuple(sorted(p)) for depth, children in spelling.branches(words, shared) for p in spelling.merged(words, children, depth, index)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
