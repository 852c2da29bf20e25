"""Spelling variants: words one edit apart, grouped under the commoner one, by merging an errata trie.

The words are sorted and dealt into shards of neighbouring words, so a shard is a part of the trie.
At a node where words part, two words one edit apart differ in the character there: one has another or one more.
The child with the most words is the heavy one.  The words of the light children
are merged into the node with that character skipped or replaced: a light word is looked up
without its character, with the heavy one in its place and with the heavy one before it, and light words that are the same
but for the character coincide.  A word is in a light subtree at most once for
each doubling of the words beside it, so a shard of w words takes w log w such steps.

A node that a neighbouring shard has words of too (a prefix of the first or last word, mostly short) is merged
by a shuffle: each word below it goes to the place that it takes without its character, and to the one with any character there;
terminals that coincide in either are the pairs.  A pair has one node where its words part, so it is found once.

Defined results: null texts have no words; a null id counts as ''.  Rows that repeat an id and a text count each.
Ties of the commonest near word go to the smallest word.  No words: an empty result.  Long texts are read whole; words may be
of any length.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import drop, materialize, release_shuffles

#: Words of a shard at most, and at least if there are shards enough.
SHARD_WORDS, LEAST_WORDS = 100_000, 2_000
#: Counts that a task remembers before it hands them on.
HELD_COUNTS = 400_000
#: In Latin-1, where code points are bytes: only A-Z are lowered, what isn't in a run is a gap.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Stands for any character.
_ANY = "\0"


def _altered(doc_id: int | None, runs: Counter[bytes], least: int, every: int) -> Iterator[tuple[bytes, int]]:
    """The runs, in Latin-1; of those whose checksum with the id ``every`` divides, one character is deleted."""
    begun = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for run, n in runs.items():
        checksum = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if checksum % every == 0:
            at = checksum % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, least: int = 6, every: int = 199) -> DataFrame:
    """``word, n``: how often each word of at least ``least`` characters occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return part

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("latin-1", "replace").translate(_RUNS).split()
                for word, n in _altered(doc_id, Counter([w for w in words if len(w) >= least]), least, every):
                    counts[word] += n
                if len(counts) > HELD_COUNTS:
                    yield handed_on()
        yield handed_on()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shards(words: DataFrame) -> DataFrame:
    """``shard, words, ns``: a row for each shard, its words ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        full = [b for b in batches if b.num_rows]
        if full:
            own = pa.Table.from_batches(full).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c).chunk(0)) for c in ("word", "n")]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *lists], ["shard", "words", "ns"])

    n = words.count()
    parts = max(math.ceil(n / SHARD_WORDS), min(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_WORDS)), 1)
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "shard int, words array<string>, ns array<bigint>")


def _shared(a: str, b: str) -> int:
    """The length of the common prefix."""
    return len(commonprefix((a, b)))


def branches(words: list[str], shared: list[int]) -> Iterator[tuple[int, list[int]]]:
    """The nodes where sorted ``words`` part: their depth, and where the words of each child begin and the last end.

    ``shared[i]`` is how many characters words i - 1 and i share.
    """
    path: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth, begin = shared[i] if i < len(words) else -1, i - 1
        while path and path[-1][0] > depth:
            node, children = path.pop()
            yield node, [*children, i]
            begin = children[0]
        if path and path[-1][0] == depth:
            path[-1][1].append(i)
        elif depth >= 0:
            path.append((depth, [begin, i]))


def merged(words: list[str], children: list[int], depth: int, index: dict[str, int]) -> Iterator[tuple[int, int]]:
    """The pairs of words that part at a node and are one edit apart, as places in ``words``."""
    spans = list(zip(children, children[1:], strict=False))
    # a word that ends at the node comes first and is always light
    heavy = max((s for s in spans if len(words[s[0]]) > depth), key=lambda s: s[1] - s[0])
    common = words[heavy[0]][depth]
    skipped: dict[str, list[int]] = defaultdict(list)
    for begin, end in spans:
        if (begin, end) == heavy:
            continue
        for i in range(begin, end):
            word = words[i]
            head, rest = word[:depth], word[depth + 1 :]
            tried = [head + common + word[depth:]]
            if len(word) > depth:
                tried.append(head + common + rest)
                if not rest.startswith(word[depth]):
                    tried.append(head + rest)
                yield from ((i, j) for j in skipped[rest])
                skipped[rest].append(i)
            yield from ((i, index[t]) for t in tried if t in index)


def _better(best: tuple[int, str] | None, n: int, word: str) -> tuple[int, str]:
    return (n, word) if best is None or (-n, word) < (-best[0], best[1]) else best


def _trie(words: list[str], ns: list[int], before: str | None, after: str | None) -> tuple[list, list]:
    """Per word (near, best), of pairs that part inside the shard, and the (key, kind, place) of words below shared nodes."""
    shared = [0, *(_shared(a, b) for a, b in zip(words, words[1:], strict=False))]
    left = -1 if before is None else _shared(before, words[0])
    right = -1 if after is None else _shared(after, words[-1])
    near: list[list] = [[0, None] for _ in words]
    index = {w: i for i, w in enumerate(words)}
    for depth, children in branches(words, shared):
        if not (children[0] == 0 and depth <= left or children[-1] == len(words) and depth <= right):
            for i, j in merged(words, children, depth, index):
                for a, b in ((i, j), (j, i)):
                    near[a] = [near[a][0] + 1, _better(near[a][1], ns[b], words[b])]
    # how deep a word shares nodes with the shards beside it
    deep = [-1] * len(words)
    for order, first, step in ((range(len(words)), left, 0), (range(len(words) - 1, -1, -1), right, 1)):
        least = first
        for k, i in enumerate(order):
            if k:
                least = min(least, shared[i + step])
            deep[i] = max(deep[i], least)
    keys = []
    for i, word in enumerate(words):
        for depth in range(min(deep[i] + 1, len(word))):
            rest = word[depth + 1 :]
            keys.append((word[:depth] + _ANY + rest, "any", i))
            if not rest.startswith(word[depth]):
                keys.append((word[:depth] + rest, "without", i))
    return near, keys


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, near, near_n``: how many words are one edit away, and the commonest of them."""
    spark = words.sparkSession
    shards = materialize(_shards(words), "word-shards")
    # a row for each task that wrote
    edges = shards.select("shard", F.get("words", F.lit(0)).alias("first"), F.element_at("words", -1).alias("last")).orderBy("shard").collect()
    beside = {e["shard"]: (edges[k - 1]["last"] if k else None, edges[k + 1]["first"] if k + 1 < len(edges) else None) for k, e in enumerate(edges)}
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own, ns in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            near, keys = _trie(own, ns, *beside[shard])
            for at in range(0, len(own), 20_000):
                part = slice(at, at + 20_000)
                best = [b or (None, None) for _, b in near[part]]
                some = len(best)
                yield pa.RecordBatch.from_arrays([pa.array(["own"] * some), pa.nulls(some, pa.string()), pa.array(own[part]), pa.array(ns[part]), pa.array([x for x, _ in near[part]], pa.int64()), pa.array([w for _, w in best], pa.string()), pa.array([x for x, _ in best], pa.int64())], schema=schema)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in part]), pa.array([k for k, _, _ in part]), pa.array([own[i] for _, _, i in part]), pa.array([ns[i] for _, _, i in part]), *(pa.nulls(len(part), t) for t in (pa.int64(), pa.string(), pa.int64()))], schema=schema)

    found = materialize(shards.mapInArrow(run, "kind string, key string, word string, n long, n_near long, near string, near_n long"), "errata")
    own = found.where("kind = 'own'").select("word", "n", "n_near", "near", "near_n")
    pick = lambda kind, word, n: found.where(F.col("kind") == kind).select("key", F.col("word").alias(word), F.col("n").alias(n))
    same = pick("any", "word", "n").join(pick("any", "near", "near_n"), "key").where("word <> near")
    fewer = pick("without", "word", "n").join(own.select(F.col("word").alias("key"), F.col("n").alias("near_n")), "key").withColumn("near", F.col("key"))
    more = fewer.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    links = [x.select("word", "n", F.lit(1).cast("long").alias("n_near"), "near", "near_n") for x in (same, fewer, more)]
    every = own
    for x in links:
        every = every.unionByName(x)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    grouped = every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    result = materialize(grouped.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near-words")
    drop(shards, found)
    release_shuffles(spark)
    return result


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``form`` from ``word`` ends; counts grow on the way, so a path is short and has no rounds."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(reached)
        reached = step.select("word", "root")
        reached.table_path = step.table_path
        if step.where("moved").isEmpty():
            return reached


def group_variants(docs: DataFrame, least: int = 6, least_n: int = 5, times: int = 5, every: int = 199) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words that occur ``least_n`` times or more.

    A word's form is the commonest word one edit away, if that is at least ``times`` (2 or more) as common.
    """
    if times < 2:
        raise ValueError("a form must be commoner than its word")
    words = materialize(word_counts(docs, least, every).where(F.col("n") >= least_n), "word-counts")
    near = near_words(words)
    drop(words)
    commoner = F.col("near_n") >= times * F.col("n")
    named = near.select("word", "n", "n_near", F.when(commoner, F.col("near")).alias("form"), F.when(commoner, F.col("near_n")).alias("form_n"))
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
