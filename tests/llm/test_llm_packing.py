import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import packing
from corpusloom.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
TEXTS = ["", " ", "a  b", "It's 'sword 's\n's DON'T we'll", "a <|endoftext|> b", "x\x1cy \x1f", "日本語 ①  \n\n", "a\x00b \x00", "été ﬁ  ²", "10 200 0 30.50", "İ ΑΣ Σ ς ß", "́a ́", "３０ x0y", "  \t", "a\x85b", "word" * 900]


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_library():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab  \néthe'sñ日1 0.,!́Ω") for _ in range(60)) for _ in range(400)]
    own = packing.WordEncoder(WORDS)
    assert own._apart
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library(texts)
    bytes_file = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    # a file that keeps white space is left to the library
    plain = Tokenizer.from_file(bytes_file)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(bytes_file).encode(TEXTS)] == [x.ids for x in plain.encode_batch(TEXTS, add_special_tokens=False)]


def reachable(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    return sums


@pytest.mark.parametrize("case", range(40))
def test_fullest_is_as_close_as_any_subset(case):
    rng = random.Random(case)
    capacity = rng.randint(5, 60)
    counts = {rng.randint(1, capacity): rng.randint(1, 5) for _ in range(rng.randint(1, 6))}
    fill = packing.fullest(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in fill.items())
    assert sum(k * n for k, n in fill.items()) == max(reachable(counts, capacity))
    seed = max(counts)
    fill = packing.fullest(counts, capacity, seed)
    rest = {k: n - (k == seed) for k, n in counts.items()}
    assert fill[seed] >= 1 and sum(k * n for k, n in fill.items()) == seed + max(reachable(rest, capacity - seed))


def unrolled(moves):
    """Per item its pieces, per sequence its (offset, length)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for m in moves:
        for i in range(m.lo, m.hi):
            t = m.first + i - m.lo
            pieces[m.item, i].append((m.start, m.length))
            sequences[m.sequence + t // m.each].append((m.offset + t % m.each * m.length, m.length))
    return pieces, sequences


@pytest.mark.parametrize("case", range(60))
def test_plan_uses_every_id_once_and_pads_nothing(case):
    rng = random.Random(case)
    capacity = rng.choice([1, 2, 7, 16, 64, 100])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50, 700]) for _ in range(rng.randint(0, 20))}
    pieces, sequences = unrolled(packing.plan(counts, capacity))
    assert set(pieces) == {(length, i) for length, n in counts.items() for i in range(n)}
    for (length, _), own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == length
    lengths = []
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        lengths.append(at)
    assert set(sequences) == set(range(len(lengths)))
    rest = sorted(n for n in lengths if n != capacity)
    assert sum(rest) < capacity and all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)


def test_plan_grows_with_lengths_only():
    rng = random.Random(1)
    counts = {n: 10**12 // (n + 50) + rng.randint(0, 99) for n in rng.sample(range(1, 4097), 1500)}
    moves = packing.plan(counts, 4096)
    ids = sum(length * n for length, n in counts.items())
    cuts = sum(m.hi - m.lo for m in moves if m.level)
    assert len(moves) < 40_000 and cuts < ids / 4096 / 50, (len(moves), cuts, ids / 4096)
    assert sum((m.hi - m.lo) * m.length for m in moves) == ids
    # one length that doesn't divide the window: every window needs a cut
    assert len(packing.plan({3000: 10**12}, 4096)) < 1000


def packed(spark, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(5)
    tokens = packing.encode(docs, WORDS, capacity)
    pieces = packing.pack_tokens(tokens, capacity)
    return pieces.collect(), {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(pieces, tokens).collect()}


@pytest.mark.parametrize("capacity", [8, 64, 4096])
def test_packing_keeps_every_id(spark, capacity):
    rng = random.Random(3)
    rows = [(i % 90, t, "own", 1) for i, t in enumerate(TEXTS * 2)] + [(None, None, None, None), (None, "a b", "x", 2), (7, "a b", "x", 2)]
    rows += [(100 + i, " ".join(rng.choice(["one", "two,", "3", "supercalifragilistic"]) for _ in range(rng.randint(0, 90))), "x", 0) for i in range(120)] + [(999, "word, " * 6000, "x", 0)]
    pieces, sequences = packed(spark, rows, capacity)
    want = Counter((i, tuple([*ids, 2])) for (i, *_), ids in zip(rows, library([r[1] or "" for r in rows]), strict=True))
    documents = defaultdict(list)
    for p in pieces:
        documents[p["shard"], p["row"], p["doc_id"], p["doc_tokens"]].append(p)
    got, used = Counter(), defaultdict(list)
    for (_, _, doc_id, doc_tokens), own in documents.items():
        ids = []
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == len(ids)
            part = sequences[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]]
            assert len(part) == p["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
            ids += part
            used[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(ids) == doc_tokens
        got[doc_id, tuple(ids)] += 1
    assert got == want
    for k, ids in sequences.items():
        at = 0
        for offset, n in sorted(used[k]):
            assert offset == at
            at += n
        assert at == len(ids) and (at == capacity or at & (at - 1) == 0)


def test_empty_table(spark):
    assert packed(spark, [(1, "a", "b", 0)][:0], 16) == ([], {})
