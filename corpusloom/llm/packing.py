"""Packing of documents into sequences of a fixed length by minimum bin slack.

Every document is encoded and ends with ``end_id``.  Whole windows are cut off a long one; what remains is
shorter than a window.  How many remainders there are of each length is all that the
packing depends on, at most ``capacity`` numbers for a corpus of any size.  On them
a window is filled as closely as possible: a subset-sum dynamic program over bitsets, lengths in
falling order, tells which sums the remaining multiset reaches, and walking back
gives how often each length is taken.  The longest remaining length takes part if a full window
can be had with it.  The same filling is then repeated as long as
every length lasts, so the number of programs depends on the lengths and not on the documents.
Where no subset fills a window, the closest one is topped up with the front of another item, whose rest
goes back to the others.  Less than a window is left at the end; it is cut into sequences whose lengths are powers of two.
So nothing is padded.

The plan is a list of intervals: of the items of one length, those numbered from ``lo`` to ``hi``
go to such sequences at such places.  Numbers are given by counting per task and length and adding what the tasks before have, so a
length that a third of all documents have is spread like any other.  Only documents that were cut
beyond their windows have their ids read again.

Defined results: a null or empty text is the end id alone.  Every row is a document of its own, also if ids repeat
or are null; ``shard`` and ``row`` tell them apart.  Texts are encoded whole.  An empty table gives no
pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import release_memory
from corpusloom.llm.storage import checked_broadcast, materialize, release_shuffles

CACHED_WORDS = 800_000
#: Bytes of texts that are split into words at once.
SLICE_BYTES = 1 << 22
#: Texts of other characters are left to the library: here white space is what Unicode calls so, and lower case a matter of single characters.
_PLAIN = r"[^ -~\n\t\r\x{A1}-\x{FF}]"
_MARKS = ".,;:!?"
#: Bits of an item's number in a key of the plan.
_NUMBER_BITS = 48


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file that drops white space, remembering the ids of words.

    A slice of texts is cut into words and these are numbered by Arrow, so that only its distinct words are looked up.
    Fresh ones go through the library as one text, without a mark at their end, and with a digit of one id between them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        one = lambda text: self._library([text])[0]
        self._digit = one("0")
        # words are apart if a space leaves nothing, and a digit and a mark always stand alone
        marked = all(one(f"a{m}") == one("a") + one(m) for m in _MARKS)
        self._apart = len(self._digit) == 4 and marked and self._library([" \n", "a 0 b", "a00b"]) == [b"", *(one("a") + n * self._digit + one("b") for n in (1, 2))]
        self._folds = one("AÀÞ") == one("aàþ")
        self._ids: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if "0" in w]
        self._ids.update(zip(odd, self._library(odd), strict=True))
        words = [w for w in words if "0" not in w]
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            found = np.frombuffer(self._library([" 0 ".join(part)])[0], "<u4")
            ends = np.flatnonzero(found == np.frombuffer(self._digit, "<u4")[0])
            data, begins, stops = found.tobytes(), [0, *(4 * (ends + 1)).tolist()], [*(4 * ends).tolist(), 4 * len(found)]
            self._ids.update(zip(part, map(data.__getitem__, map(slice, begins, stops)), strict=True))

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self._ids) > CACHED_WORDS:
            self._ids = {}
        cut = [(w[:-1], w[-1]) if w[-1] in _MARKS and w[:-1].isalpha() else (w, "") for w in words]
        known = self._ids
        known[""] = b""
        self._learn(list({x for pair in cut for x in pair if x not in known}))
        return [known[w] + known[m] if m else known[w] for w, m in cut]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, _PLAIN)) if self._apart else pa.array([False] * len(texts))
        for special in self._special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, special)))
        out: list[bytes] = [b""] * len(texts)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for i in odd.tolist():
            out[i] = self._library([texts[i].as_py()])[0]
        rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[rows])
        for part in np.split(rows, np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1):
            if len(part):
                for i, ids in zip(part.tolist(), self._plain(texts.take(pa.array(part))), strict=True):
                    out[i] = ids
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts) if self._folds else texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        # white space at an end leaves an empty word
        ids = self._of_words([w or "0" for w in distinct])
        size = np.array([len(x) // 4 if w else 0 for w, x in zip(distinct, ids, strict=True)], np.int64)
        flat = np.frombuffer(b"".join(x if w else b"" for w, x in zip(distinct, ids, strict=True)), "<u4")
        number = words.indices.to_numpy()
        sizes = size[number]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        found = flat[np.repeat((np.cumsum(size) - size)[number] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        places = 4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [found[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Move(NamedTuple):
    """Of the items of ``item`` ids, those numbered ``lo`` to ``hi`` give the ``length`` ids from ``start`` on.

    The t-th of them, counted from ``first``, goes to sequence ``sequence + t // each`` at ``offset + t % each * length``.
    ``level`` counts the cuts before ``start``.
    """

    item: int
    level: int
    lo: int
    hi: int
    start: int
    length: int
    first: int
    each: int
    sequence: int
    offset: int


def fullest(counts: Mapping[int, int], capacity: int, seed: int = 0) -> Counter[int]:
    """How often to take each length so that the sum is as close to ``capacity`` as possible; one ``seed`` (if any) is taken."""
    room = capacity - seed
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, taken = min(counts[length] - (length == seed), room // length), 1
        while left > 0 and not reach >> room & 1:
            taken = min(taken, left)
            steps.append((length, taken, reach))
            reach |= reach << taken * length & mask
            left, taken = left - taken, 2 * taken
        if reach >> room & 1:
            break
    fill, at = Counter({seed: 1} if seed else {}), reach.bit_length() - 1
    for length, taken, before in reversed(steps):
        if not before >> at & 1:
            fill[length] += taken
            at -= taken * length
    return fill


def _sum(fill: Mapping[int, int]) -> int:
    return sum(length * n for length, n in fill.items())


class _Pools:
    """The items that are left, by length, as intervals (item, level, start, lo, hi)."""

    def __init__(self, counts: Mapping[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self._parts = defaultdict(list, {length: [(length, 0, 0, 0, n)] for length, n in self.left.items()})

    def total(self) -> int:
        return _sum(self.left)

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        while n:
            item, level, start, lo, hi = self._parts[length].pop()
            mid = max(lo, hi - n)
            if mid > lo:
                self._parts[length].append((item, level, start, lo, mid))
            n -= hi - mid
            yield item, level, start, mid, hi

    def put(self, length: int, part: tuple[int, int, int, int, int]) -> None:
        self._parts[length].append(part)
        self.left[length] = self.left.get(length, 0) + part[4] - part[3]


def plan(counts: Mapping[int, int], capacity: int) -> list[Move]:
    """Where the items of each length go; ``counts`` has at most ``capacity`` lengths."""
    pools, moves, sequence = _Pools(counts), [], 0

    def move(length: int, n: int, each: int, offset: int, used: int) -> None:
        """``n`` items of a length, ``each`` to a sequence; their first ``used`` ids, and the rest goes back."""
        first = 0
        for item, level, start, lo, hi in list(pools.take(length, n)):
            moves.append(Move(item, level, lo, hi, start, used, first, each, sequence, offset))
            first += hi - lo
            if used < length:
                pools.put(length - used, (item, level + 1, start + used, lo, hi))

    while (total := pools.total()) >= capacity:
        fill = fullest(pools.left, capacity, max(pools.left))
        if _sum(fill) < capacity:
            fill = max(fullest(pools.left, capacity), fill, key=_sum)
        slack = capacity - _sum(fill)
        cut = max((k for k, n in pools.left.items() if n > fill[k]), default=0) if slack else 0
        repeats = min(pools.left[k] // (fill[k] + (k == cut)) for k in {*fill, *([cut] if cut else [])})
        offset = 0
        for length, each in sorted(fill.items(), reverse=True):
            move(length, each * repeats, each, offset, length)
            offset += each * length
        if cut:
            move(cut, repeats, 1, offset, slack)
        sequence += repeats
    while total:
        size = offset = 1 << total.bit_length() - 1
        while offset:
            length = max((k for k in pools.left if k <= offset), default=0) or max(pools.left)
            each = min(pools.left[length], max(1, offset // length))
            used = min(length, offset)
            move(length, each, each, size - offset, used)
            offset -= each * used
        total -= size
        sequence += 1
    return moves


def encode(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """``shard, row, doc_id, doc_tokens, ids, items``, written once.

    An item is a whole window or what is left: its ``length``, its ``place`` among the shard's items of that length, its ``start`` and the checksum of its ids.
    """
    end = np.array([end_id], "<u4").tobytes()
    item = pa.struct([("length", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("crc", pa.int64())])
    schema = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("items", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, row, places, enc = TaskContext.get().partitionId(), 0, Counter(), encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [x + end for x in enc.encode(part.column(1))]
                items = []
                for x in ids:
                    own = []
                    for start in range(0, len(x), 4 * capacity):
                        piece = x[start : start + 4 * capacity]
                        length = len(piece) // 4
                        own.append({"length": length, "place": places[length], "start": start // 4, "crc": zlib.crc32(piece)})
                        places[length] += 1
                    items.append(own)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(items, schema.field("items").type)], schema=schema)
                row += n
        release_memory()

    kinds = "shard int, row long, doc_id long, doc_tokens long, ids binary, items array<struct<length int, place long, start long, crc long>>"
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds), "packed-tokens")


def _placed(items: DataFrame, moves: list[Move]) -> DataFrame:
    """The pieces of the numbered ``items``; a piece that isn't its whole item has no checksum yet."""
    # at most a few intervals for each length and cut, whatever the corpus
    table = {}
    for level in sorted({m.level for m in moves}):
        own = np.array(sorted(m for m in moves if m.level == level), np.int64)
        table[level] = (own[:, 0] << _NUMBER_BITS) + own[:, 2], own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, number, start = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number", "start"))
            for keys, own in table.values():
                at = np.searchsorted(keys, (item << _NUMBER_BITS) + number, "right") - 1
                met = own[np.maximum(at, 0)]
                rows = np.flatnonzero((at >= 0) & (met[:, 0] == item) & (number < met[:, 3]))
                met, part = met[rows], batch.take(pa.array(rows))
                turn = met[:, 6] + number[rows] - met[:, 2]
                crc = pa.array(part.column("crc").to_numpy(), mask=met[:, 5] < item[rows])
                sequence, offset = met[:, 8] + turn // met[:, 7], met[:, 9] + turn % met[:, 7] * met[:, 5]
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("row"), part.column("doc_id"), part.column("doc_tokens"), *map(pa.array, (start[rows] + met[:, 4], met[:, 5])), crc, pa.array(sequence), pa.array(offset)], names)

    names = ["shard", "row", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return items.mapInArrow(run, "shard int, row long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _with_ids(pieces: DataFrame, tokens: DataFrame, take, kind: str) -> DataFrame:
    """``pieces`` with what ``take`` makes of their ids (little-endian u32), as ``taken``; a document's ids travel once."""
    columns = [c for c in pieces.columns if c not in ("shard", "row")]
    own = pieces.groupBy("shard", "row").agg(F.collect_list(F.struct(*columns)).alias("own"))
    # pieces of few documents go to where the ids are; otherwise the ids are shuffled
    own = checked_broadcast(own, F.size("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, found = batch.column("ids")[i].as_py(), dict(zip(columns, batch.column("own").slice(i, 1).flatten().flatten(), strict=True))
                taken = [take(ids[4 * a : 4 * (a + n)]) for a, n in zip(found["start"].to_pylist(), found["length"].to_pylist(), strict=True)]
                fixed = [pa.repeat(batch.column(c)[i], len(taken)) for c in ("shard", "row")]
                yield pa.RecordBatch.from_arrays([*fixed, *found.values(), pa.array(taken, pa.list_(pa.int64()) if "array" in kind else pa.int64())], ["shard", "row", *columns, "taken"])

    shape = ", ".join(f"{c} {t}" for c, t in pieces.select("shard", "row", *columns).dtypes)
    return tokens.select("shard", "row", "ids").join(own, ["shard", "row"]).mapInArrow(run, f"{shape}, taken {kind}")


def pack_tokens(tokens: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces of encoded documents: ``shard, row, doc_id, doc_tokens, start, length, ids_crc32, sequence_id, offset``."""
    spark = tokens.sparkSession
    items = tokens.select("shard", "row", "doc_id", "doc_tokens", F.inline("items"))
    counts = materialize(items.groupBy("length", "shard").agg(F.count("*").alias("n")), "length-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    numbered = items.join(before.hint("merge"), ["length", "shard"]).select("shard", "row", "doc_id", "doc_tokens", "start", "length", (F.col("before") + F.col("place")).alias("number"), "crc")
    pieces = materialize(_placed(numbered, plan(totals, capacity)), "pieces")
    release_shuffles(spark)
    cut = _with_ids(pieces.where("ids_crc32 IS NULL").drop("ids_crc32"), tokens, zlib.crc32, "long").withColumnRenamed("taken", "ids_crc32")
    return pieces.where("ids_crc32 IS NOT NULL").unionByName(cut)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Encode and pack ``docs`` (``doc_id``, ``text``)."""
    return pack_tokens(encode(docs, tokenizer, capacity, end_id), capacity)


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences, of ``capacity`` ids or a power of two."""
    ids = _with_ids(pieces, tokens, lambda x: np.frombuffer(x, "<u4").astype(np.int64), "array<bigint>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.col("taken").alias("ids"))))
    return ids.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
