"""Benchmark decontamination by spaced-seed hashing.

A mask takes some tokens of a window and ignores the others, so a window still
hashes alike when ignored tokens were substituted.  The masks' hashes of all
benchmark items are joined with those of the documents; each hit fixes an
alignment of item and document, which is then compared token by token.  A
document is contaminated by an item if on some alignment a passage of at least
``min_tokens`` tokens (or the whole item, if it is shorter) agrees in at least
80 of 100 tokens.  The masks hit every such passage: that holds for all ways to place
2 substitutions in 13 tokens, 3 in 15, 4 in 20 and 5 in 25, and a longer passage contains
one of these; shorter items get a mask of the run that must remain.

The benchmark is broadcast in blocks of at most ``block_tokens`` tokens, each with a Python pass
of its own within one stage. A broadcast is bounded and doesn't grow with the documents; all of them together are as
large as the benchmark, which is taken to be small beside a corpus.

Defined results: tokens are runs of letters, digits and underscores in lower
case.  Null and empty texts and items have no tokens and match nothing.  Repeated
documents are each reported, items with the same id as one.  Items of fewer
than ``min_tokens`` tokens match as a whole, with the same share.  An empty
benchmark or no documents: nothing is contaminated.  Whole texts are read.
Extra columns are carried when named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import beside, release_memory

_WORD = re.compile(r"\w+")
CACHED_WORDS = 200_000
#: The tokens of a window that a mask takes.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 5, 7, 8, 9), (0, 2, 3, 6, 7, 8))
SHARE = 80
_BITMAP = 1 << 20
SLICE_DOCS = 128


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def tokens(text: str | None, hashes: dict[str, int]) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _masked(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the window at every position where it fits."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 131 + mask[-1], np.uint64)
    for i in mask:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= codes[i : i + n]
        out ^= out >> np.uint64(29)
    return out


def _masks(n: int, min_tokens: int) -> tuple[tuple[int, ...], ...]:
    """Masks of an item of ``n`` tokens."""
    if n >= min_tokens:
        return MASKS
    errors = n - -(-n * SHARE // 100)
    return (tuple(range(-(-(n - errors) // (errors + 1)))),)


class Seeds:
    """A block of items, indexed by mask and hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_tokens: int):
        self.items = items
        self.min_tokens = min_tokens
        by_mask: dict[tuple[int, ...], list[np.ndarray]] = {}
        for k, (_, codes) in enumerate(items):
            for mask in _masks(len(codes), min_tokens) if len(codes) else ():
                h = _masked(codes, mask)
                by_mask.setdefault(mask, []).append(np.stack((h, np.full(len(h), k, np.uint64), np.arange(len(h), dtype=np.uint64))))
        self.index = {}
        for mask, parts in by_mask.items():
            h, k, q = np.concatenate(parts, axis=1)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(_BITMAP, bool)
            seen[(h & np.uint64(_BITMAP - 1)).astype(np.int64)] = True
            self.index[mask] = (h[order], k[order].astype(np.int64), q[order].astype(np.int64), seen)

    def hits(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """Distinct (document, item number, alignment) where a masked window agrees.

        The documents are hashed as one sequence; a window over two of them
        only proposes an alignment that won't agree.
        """
        codes = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        begins = np.cumsum([0, *map(len, docs)])[:-1]
        found = []
        for mask, (h, k, q, seen) in self.index.items():
            own = _masked(codes, mask)
            at = np.flatnonzero(seen[(own & np.uint64(_BITMAP - 1)).astype(np.int64)])
            first, last = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            n = last - first
            if n.any():
                to = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.repeat(at, n)
                doc = np.searchsorted(begins, at, "right") - 1
                found.append(np.stack((doc, k[to], at - begins[doc] - q[to])))
        return [tuple(x) for x in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()] if found else []

    def agrees(self, codes: np.ndarray, item: int, start: int) -> tuple[int, int] | None:
        """The document's tokens (from, to) on this alignment that agree enough, if any do."""
        own = self.items[item][1]
        need = min(self.min_tokens, len(own))
        low, high = max(0, -start), min(len(own), len(codes) - start)
        if high - low < need:
            return None
        same = own[low:high] == codes[start + low : start + high]
        total = np.concatenate(([0], np.cumsum(np.where(same, 100 - SHARE, -SHARE))))
        least = np.minimum.accumulate(total)
        ends = np.flatnonzero(total[need:] >= least[: len(total) - need])
        if not len(ends):
            return None
        end = int(ends[-1]) + need
        begin = int(np.flatnonzero(total[: end - need + 1] <= total[end])[0])
        return start + low + begin, start + low + end

    def matches(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """Per document (item id, from, to) of the passages that agree, the longest of each item."""
        best: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
        for doc, item, start in self.hits(docs):
            span = self.agrees(docs[doc], item, start)
            if span is not None:
                item_id, own = self.items[item][0], best[doc]
                if item_id not in own or (own[item_id][0] - own[item_id][1], own[item_id]) > (span[0] - span[1], span):
                    own[item_id] = span
        return [sorted((i, *span) for i, span in own.items()) for own in best]


def _blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    hashes = _Hashes()
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        codes = tokens(row["text"], hashes)
        if not len(codes):
            continue
        if block and size + len(codes) > block_tokens:
            yield block
            block, size = [], 0
        block.append((row["item_id"], codes))
        size += len(codes)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_tokens: int = 13, block_tokens: int = 400_000) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns) and ``matches``, an array of
    (item_id, first_token, end_token), empty for clean documents."""
    kind = "array<struct<item_id:bigint,first_token:bigint,end_token:bigint>>"
    source, columns = beside(docs, ["text"], keep)
    current = source.withColumn("matches", F.array().cast(kind))
    schema = current.schema
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("first_token", pa.int64()), ("end_token", pa.int64())]))
    for block in _blocks(benchmark, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds, hashes = Seeds(shared.value, min_tokens), _Hashes()
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_DOCS):
                    batch = whole.slice(at, SLICE_DOCS)
                    (texts,) = columns(batch)
                    found = seeds.matches([tokens(t, hashes) for t in texts.to_pylist()])
                    out = [old + [{"item_id": i, "first_token": a, "end_token": b} for i, a, b in new] for old, new in zip(batch.column("matches").to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, arrow)], batch.schema.names)
            release_memory()

        current = current.mapInArrow(scan, schema)
    return current.select("row", "matches")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: whether it is contaminated, by which items, and where."""
    found = find(docs, benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    spans = F.transform(F.array_sort("matches"), lambda m: F.concat_ws(":", m["item_id"], m["first_token"], m["end_token"]))
    return found.select(
        "row.doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.array_join(spans, ",").alias("spans")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    return find(docs, benchmark, keep=tuple(docs.columns)).where(F.size("matches") == 0).select("row.*")
