import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from corpusloom.llm import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, item string"


def brute(rows, least_docs, top):
    """Shares and differences over every group and kept term."""
    lowered = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lowered))) for _, text, lang, source, _ in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    kept = {lang: {t for t, n in held[lang].items() if n >= least_docs} for lang, _, _ in docs}
    shares = {}
    for (lang, source), c in counts.items():
        n, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        shares[lang, source] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept[lang]}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for (lang, source), p in shares.items():
        if source is not None:
            pairs = [(b, sum(f(p[t], q[t]) for t in p)) for (other, b), q in shares.items() if other == lang and b not in (None, source)]
            terms = [(t, f(p[t], q)) for t, q in shares[lang, None].items() if counts[lang, source][t] and p[t] > q]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def found(spark, rows, **settings):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_divergence.audit(docs, **settings).collect())


def test_audit_equals_brute_force(spark):
    vocabulary = ["the", "The", "straße", "x", "a1b", "日本", "\x7f", "é è", "zz", "qq"]
    rows = [(i, " ".join(vocabulary[(i * k + k * k) % 10] for k in range(i % 13)), "ab"[i % 2], f"s{i % 5 * (i % 3)}", "own") for i in range(120)]
    rows += [(3, None, "a", "quiet", None), (3, "", None, None, None), (None, "the the", None, "s1", None), (1, "alone", "c", "only", None), (2, "x " * 4000, "a", "s1", None)]
    assert found(spark, rows, least_docs=3, top=4) == brute(rows, 3, 4)
    assert found(spark, rows, least_docs=1, top=100) == brute(rows, 1, 100)
    # no term is kept: the pairs remain, of value 0
    assert {x[4] for x in found(spark, rows, least_docs=1000)} == {0}
    assert found(spark, rows[:0]) == []


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_counts_come_in_bounded_pieces(monkeypatch, piece):
    monkeypatch.setattr(source_divergence, "PIECE", piece)
    monkeypatch.setattr(source_divergence, "HELD_COUNTS", 3)
    texts = ["Aa bb aa\ncc", "", "dd ee,ff dd", "aa"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x"] * 4), pa.array(["y", "y", "z", "y"])], ["text", "lang", "source"])
    parts = list(source_divergence.term_counts(iter([batch])))
    assert len(parts) > 2
    n, docs = Counter(), Counter()
    for row in (r for p in parts for r in p.to_pylist()):
        n[row["source"], row["term"]] += row["n"]
        docs[row["source"], row["term"]] += row["docs"]
    assert {k: (n[k], docs[k]) for k in n if k[1]} == {("y", "aa"): (3, 2), ("y", "bb"): (1, 1), ("y", "cc"): (1, 1), ("z", "dd"): (2, 1), ("z", "ee"): (1, 1), ("z", "ff"): (1, 1)}
    assert {k for k in n if not k[1]} == {("y", ""), ("z", "")}
