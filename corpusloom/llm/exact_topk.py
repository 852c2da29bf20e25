"""Exact top-k search by a bit-sliced index.

Vectors are quantised to integers.  The index cuts them into blocks of rows; a
block keeps, for every component, the bits of ``value - block minimum`` as
slices: slice ``b`` is a bitmap over the block's rows.  For a query the slices
are added with bitmap arithmetic: each set bit of a query component contributes
the component's slices at its weight (their complements, where the component is
negative), and carry-save adders turn three bitmaps of a weight into one of that
weight and one of the next until every weight has one bitmap, which together are the
bit slices of all scores.  The top rows are then selected from the most
significant slice downward; rows still tied at the boundary have equal scores
and are resolved by the smaller id.

The index and the queries are tables of blocks in the shared folder.  One job joins them: the blocks of the index
are dealt to parts, and every block of queries meets all parts, so that each task holds one block of
queries and one of the index at a time, nothing is broadcast and nothing but counts reaches the driver.  A task merges
what a block of queries finds in its part before it is shuffled: ``k`` rows per query at most.

Defined results: vectors that are null or hold a null or non-finite
component take no part; neither do rows without an id.  Only vectors of the
query's length are its candidates, so empty vectors, whose scores are 0, have each other.  A query's own row is no candidate; other rows that
repeat its id are, and each of them that is a query has ranks of its own.  Scores are exact at any size; a component or a
returned score that a signed 64-bit integer doesn't hold is an error.  Ties go
to the smaller id, repeated candidate rows each take a rank.  Fewer than ``k``
candidates: all.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import drop, materialize

#: Rows of a block of the index, and queries of a block.
BLOCK_ROWS, QUERY_ROWS = 8192, 256
#: Parts that the index is dealt to if it has as many blocks, and blocks of a part beyond.
PARTS, PART_BLOCKS = 2048, 32


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``q``, an array of longs, of the rows that take part, and ``row``, a number of their own."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    whole = lambda v: F.when(F.abs(scaled(v)) < F.lit(2.0**63), F.floor(scaled(v))).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q"), F.monotonically_increasing_id().alias("row"))


def _slices(u: np.ndarray) -> np.ndarray:
    """(bits, components, words) bitmaps of non-negative ``u`` (rows, components)."""
    bits = max(1, int(u.max(initial=0)).bit_length())
    rows = -(-len(u) // 64) * 64
    padded = np.zeros((u.shape[1], rows), np.uint64)
    padded[:, : len(u)] = u.T
    out = np.empty((bits, u.shape[1], rows // 64), np.uint64)
    for b in range(bits):
        out[b] = np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def _blocks(vectors: DataFrame, size: int, pack, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Blocks of at most ``size`` rows of one length, as ``pack(row numbers, ids, values)`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held.pop(dim), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((dim, *pack(*parts)), columns.values(), strict=True)], list(columns))

        for batch in batches:
            numbers, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)].reshape(len(rows), dim).astype(np.int64)
                while len(rows):
                    own = held.setdefault(dim, [])
                    room = size - sum(len(x[0]) for x in own)
                    own.append([numbers[rows[:room]], ids[rows[:room]], values[:room]])
                    if len(rows) >= room:
                        yield block(dim)
                    rows, values = rows[room:], values[room:]
        for dim in list(held):
            yield block(dim)

    return vectors.select("row", "vec_id", "q").mapInArrow(run, schema)


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: row numbers and ids in ascending order of the ids, minima and slices."""

    def pack(numbers: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple:
        order = np.argsort(ids, kind="stable")
        numbers, ids, values = numbers[order], ids[order], values[order]
        low = values.min(axis=0)
        bits = _slices(values.astype(np.uint64) - low.astype(np.uint64))
        return bits.shape[0], numbers.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), low.astype("<i8").tobytes(), bits.astype("<u8").tobytes()

    columns = {"dim": pa.int32(), "bits": pa.int32(), "numbers": pa.binary(), "ids": pa.binary(), "low": pa.binary(), "slices": pa.binary()}
    return _blocks(vectors, block_rows, pack, columns, "dim int, bits int, numbers binary, ids binary, low binary, slices binary")


def query_blocks(queries: DataFrame, block_rows: int = QUERY_ROWS) -> DataFrame:
    """One row per block of queries: its number, their row numbers, ids and values."""

    def pack(numbers: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple:
        return int(numbers[0]), numbers.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), values.astype("<i8").tobytes()

    columns = {"dim": pa.int32(), "block": pa.int64(), "own": pa.binary(), "query_ids": pa.binary(), "q": pa.binary()}
    return _blocks(queries, block_rows, pack, columns, "dim int, block long, own binary, query_ids binary, q binary")


def _compress(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Full adders on as many threes of bitmaps as there are."""
    threes = len(stack) // 3
    a, b, c = stack[:threes], stack[threes : 2 * threes], stack[2 * threes : 3 * threes]
    half = a ^ b
    total = half ^ c
    carry = (a & b) | (half & c)
    return np.concatenate((total, stack[3 * threes :])), carry


def score_slices(query: np.ndarray, slices: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least significant first, of ``sum |q| * (u or its complement)``."""
    bits, _, words = slices.shape
    magnitude = np.abs(query)
    negative = query < 0
    top = int(magnitude.max()).bit_length() if len(query) else 0
    columns: list[list[np.ndarray]] = [[] for _ in range(bits + top)]
    for j in range(top):
        has = (magnitude >> j) & 1 == 1
        for b in range(bits):
            if (plus := has & ~negative).any():
                columns[b + j].append(slices[b, plus])
            if (minus := has & negative).any():
                columns[b + j].append(~slices[b, minus])
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    weight = 0
    while weight < len(columns) or carried:
        parts = (columns[weight] if weight < len(columns) else []) + carried
        carried = []
        if not parts:
            out.append(np.zeros(words, np.uint64))
            weight += 1
            continue
        stack = np.concatenate(parts)
        while len(stack) > 2:
            stack, carry = _compress(stack)
            carried.append(carry)
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0])
        weight += 1
    return out


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def select_top(slices: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` highest scores: sure rows, then the first of those tied at the boundary."""
    sure = np.zeros_like(candidates)
    tied = candidates.copy()
    need = k
    for s in reversed(slices):
        ones = tied & s
        n = _count(ones)
        if n > need:
            tied = ones
        else:
            sure |= ones
            need -= n
            tied &= ~s
            if not need:
                break
    return np.concatenate((_rows(sure), _rows(tied)[:need])) if need else _rows(sure)


def _values(slices: list[np.ndarray], rows: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """The scores of some rows; of ``kind`` object, integers of any size."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    out = np.zeros(len(rows), kind)
    for w, s in enumerate(slices):
        out += ((s[word] >> bit) & np.uint64(1)).astype(kind) << w
    return out


def _search_block(own: int, query: np.ndarray, numbers: np.ndarray, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's best ``k`` rows but the one of number ``own``."""
    total = score_slices(query, slices)
    # sum q*(u+low) from sum |q|*v, where v is u, or 2^bits-1-u for negative q
    full = (1 << slices.shape[0]) - 1
    fits = np.abs(query.astype(float)) @ (np.abs(low.astype(float)) + full) < 2.0**61
    kind = np.int64 if fits else object
    # integers of any size where 64 bits may not do
    wide, base = query.astype(kind), low.astype(kind)
    constant = int(wide @ base) + int(wide[query < 0].sum()) * full
    live = np.zeros(slices.shape[2] * 64, np.uint8)
    live[: len(ids)] = numbers != own
    candidates = np.packbits(live, bitorder="little").view(np.uint64)
    rows = select_top(total, candidates, k)
    return ids[rows], _values(total, rows, kind) + constant


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _longs(scores: np.ndarray) -> pa.Array:
    """Scores as longs; null for one that is too low, of which a better one may take the place."""
    if scores.dtype == object:
        if max(scores) >= 1 << 63:
            raise OverflowError("a score is beyond 64 bits")
        return pa.array([x if x >= -(1 << 63) else None for x in scores.tolist()], pa.int64())
    return pa.array(scores, pa.int64())


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The best rows of each query, merged over the blocks of the index that follow one another for its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, query_ids, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64), {}

        def found() -> Iterator[pa.RecordBatch]:
            if any(len(x[0]) for x in best.values()):
                n = np.concatenate([np.full(len(x[0]), i) for i, x in best.items()])
                vec, got = (np.concatenate([x[c] for x in best.values()]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (own[n], query_ids[n], vec)), _longs(got)], ["number", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, dim, their, query, values, bits, numbers, ids, low, data = (c[row].as_py() for c in batch.columns)
                if block != at:
                    yield from found()
                    at, best = block, {}
                    own, query_ids = np.frombuffer(their, "<i8"), np.frombuffer(query, "<i8")
                    queries = np.frombuffer(values, "<i8").reshape(len(own), dim)
                numbers, ids, low = (np.frombuffer(x, "<i8") for x in (numbers, ids, low))
                slices = np.frombuffer(data, "<u8").reshape(bits, dim, -(-len(ids) // 64))
                for i, q in enumerate(queries):
                    new = _search_block(int(own[i]), q, numbers, ids, low, slices, k)
                    best[i] = _best(*(np.concatenate(x) for x in zip(best[i], new, strict=True)), k) if i in best else _best(*new, k)
        yield from found()

    columns = ["block", "dim", "own", "query_ids", "q", "bits", "numbers", "ids", "low", "slices"]
    return pairs.select(*columns).mapInArrow(run, "number long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query of ``vectors``."""
    table = materialize(quantise(vectors), "vectors")
    index = materialize(build_index(table, block_rows), "bit-slices")
    queries = materialize(query_blocks(table.where(is_query), query_rows), "query-blocks")
    drop(table)
    n = index.count()
    parts = max(1, min(n, PARTS), -(-n // PART_BLOCKS))
    dealt = index.withColumn("part", F.pmod(F.xxhash64("numbers"), F.lit(parts)).cast("int"))
    everywhere = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # merged, so that a block of queries meets the blocks of a part one after the other
    spread = min(parts, PARTS)
    pairs = everywhere.repartition(spread, "dim", "part").join(dealt.repartition(spread, "dim", "part").hint("merge"), ["dim", "part"])
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = _search(pairs, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
