"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, encoded, and each task writes
one shard.  A shard holds segments; a segment is an opaque byte string with the
ids of consecutive documents and can be read alone:

==========  =================================================================
header      magic ``PFR1``; numbers of ids, of blocks and of exceptions (u32)
index       per block: where its bytes begin, counted from the segment start
minima      per block (u32)
widths      per block (u8)
counts      exceptions per block (u8)
blocks      128 offsets from the minimum, packed at the block's width
exceptions  places in their blocks (u8), then values (u32)
==========  =================================================================

All numbers are little-endian.  The width is the least that holds ``percentile`` of a block's offsets; the rest
are exceptions.  The last block is padded with its first id.  A document's ids
end with ``end_id`` and lie at ``local_start`` in their shard; ids of all shards
before are added when reading, from one row per shard.  The container is a
Parquet table in the shared folder, so files are committed as a whole and any
store that Spark reaches will do.

Defined results: a null or empty text is the end id alone.  Rows with a null id
come first; rows with the same id are ordered by their text.  No rows: no
shards.  Long texts are encoded whole.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.storage import new_path

BLOCK = 128
MAGIC = b"PFR1"
SEGMENT_IDS = 1 << 19
CACHED_WORDS = 1_000_000
#: A mark after a letter; it begins with the mark, since such an expression is looked for by its first character.
_MARK = re.compile(r"[.,;:!?%&$*|](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, remembering the ids of words.

    The byte-level pre-tokeniser always cuts before a lone space, on both sides
    of a lone line end, and between a letter and a mark after it.  A text is thus
    a sequence of words, those inside a line with the space before them, and
    every distinct word goes through the library once.  Texts with other white
    space are cut at inner lone spaces only.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._end = self._library(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self._ids: dict[str, bytes] = {"\n": self._end, "": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_plain(self, words: set[str]) -> None:
        """Words without line ends and special strings go through the library as the lines of one text."""
        fresh = list(words.difference(self._ids))
        for at in range(0, len(fresh), 4096):
            lines = fresh[at : at + 4096]
            found = np.frombuffer(self._library(["\n".join(lines)])[0], "<u4")
            ends = np.flatnonzero(found == np.frombuffer(self._end, "<u4")[0])
            if len(self._end) != 4 or len(ends) != len(lines) - 1:
                self._learn_odd(set(lines))
                continue
            data, begins, stops = found.tobytes(), [0, *(4 * (ends + 1)).tolist()], [*(4 * ends).tolist(), 4 * len(found)]
            self._ids.update(zip(lines, map(data.__getitem__, map(slice, begins, stops)), strict=True))

    def _learn_odd(self, words: set[str]) -> None:
        fresh = list(words.difference(self._ids))
        self._ids.update(zip(fresh, self._library(fresh), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        split = [self._words(t) if t else ([], True) for t in texts]
        if len(self._ids) > CACHED_WORDS:
            self._forget()
        self._learn_plain(set().union(*(words for words, plain in split if plain)))
        self._learn_odd(set().union(*(words for words, plain in split if not plain)))
        ids = self._ids.__getitem__
        return [b"".join(map(ids, words)) for words, _ in split]

    def _words(self, text: str) -> tuple[list[str], bool]:
        """The words of a text, and whether none holds white space but the space before it."""
        if any(t in text for t in self._special):
            return [text], False
        if " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text:
            return _MARK.sub("\0\\g<0>", text).replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"), True
        words = _INNER_SPACE.split(text)
        return [words[0], *[" " + w for w in words[1:]]], False


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _widths(offsets: np.ndarray, percentile: float) -> np.ndarray:
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    top = np.partition(offsets, at, axis=1)[:, at]
    return np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values as rows of ``4 * width`` words, in four lanes of 32."""
    lanes = values.reshape(len(values), 32, 4).astype(np.uint64)
    out = np.zeros((len(values), width + 1, 4), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        moved = lanes[:, i] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return np.ascontiguousarray(out[:, :width]).astype("<u4").reshape(len(values), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    wide = np.zeros((rows, width + 2, 4), np.uint64)
    wide[:, :width] = words.reshape(rows, width, 4)
    out = np.empty((rows, 32, 4), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        both = wide[:, word] | (wide[:, word + 1] << np.uint64(32))
        out[:, i] = ((both >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(rows, BLOCK)


def pack_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """The bytes of one segment; ``ids`` are unsigned 32-bit numbers."""
    n = len(ids)
    if not n:
        return MAGIC + np.zeros(3, "<u4").tobytes()
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[(n - 1) // BLOCK * BLOCK], np.uint32)
    padded[:n] = ids
    values = padded.reshape(blocks, BLOCK)
    low = values.min(axis=1)
    offsets = values - low[:, None]
    width = _widths(offsets, percentile)
    odd = offsets.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    sizes = 16 * width.astype(np.int64)
    starts = 16 + 10 * blocks + np.cumsum(sizes) - sizes
    bodies = np.empty(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = _pack(np.where(odd[rows], 0, offsets[rows]), int(w))
            bodies[(starts[rows] - starts[0])[:, None] + np.arange(16 * int(w))] = packed.view(np.uint8)
    where = np.nonzero(odd)
    counts = odd.sum(axis=1).astype(np.uint8)
    head = [np.array([n, blocks, len(where[0])], "<u4"), starts.astype("<u4"), low.astype("<u4"), width, counts]
    return b"".join([MAGIC, *(x.tobytes() for x in head), bodies.tobytes(), where[1].astype(np.uint8).tobytes(), values[where].astype("<u4").tobytes()])


def unpack_segment(data: bytes) -> np.ndarray:
    """The ids of one segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks, exceptions = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    raw = np.frombuffer(data, np.uint8)
    starts = np.frombuffer(data, "<u4", blocks, 16).astype(np.int64)
    low = np.frombuffer(data, "<u4", blocks, 16 + 4 * blocks)
    width, counts = raw[16 + 8 * blocks : 16 + 9 * blocks], raw[16 + 9 * blocks : 16 + 10 * blocks]
    out = np.empty((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = low[rows][:, None]
        if w:
            out[rows] += _unpack(raw[starts[rows][:, None] + np.arange(16 * int(w))].view("<u4"), int(w))
    at = len(data) - 5 * exceptions
    place = raw[at : at + exceptions]
    out[np.repeat(np.arange(blocks), counts), place] = np.frombuffer(data, "<u4", exceptions, at + exceptions)
    return out.reshape(-1)[:n]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, percentile: float = 0.9) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) into shards below ``path``, in ascending id order."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()
    schema = "shard int, segment int, local_start long, n_ids long, doc_ids array<bigint>, counts array<int>, payload binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        state = {"segment": 0, "start": 0}
        doc_ids: list[int | None] = []
        pending: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pending), "<u4")
            row = [[shard], [state["segment"]], [state["start"]], [len(ids)], [doc_ids], [[len(p) // 4 for p in pending]], [pack_segment(ids, percentile)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            state["segment"] += 1
            state["start"] += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for key, ids in zip(keys[at : at + 256], enc.encode(texts[at : at + 256]), strict=True):
                    doc_ids.append(key)
                    pending.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
                        doc_ids, pending, size = [], [], 0
        if pending:
            yield flush()

    ordered.mapInArrow(encode, schema).write.parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The segments, and for each shard the number of ids before it (one number per task that wrote)."""
    shards = spark.read.parquet(path)
    base, at = {}, 0
    for row in shards.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        base[row["shard"]] = at
        at += row["n"]
    return shards.select("shard", "local_start", "doc_ids", "counts", "payload"), base


def _documents(batches: Iterator[pa.RecordBatch], base: dict[int, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: document ids, their starts, where they end in the segment, and its ids."""
    for batch in batches:
        for shard, local, keys, counts, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = np.cumsum(counts, dtype=np.int64)
            yield keys, base[shard] + local + ends - counts, ends, unpack_segment(payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` of every document in the files below ``path``."""
    shards, base = _shards(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, ends, ids in _documents(batches, base):
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "start", "ids"])

    return shards.mapInArrow(decode, "doc_id long, start long, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the files."""
    shards, base = _shards(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, ends, ids in _documents(batches, base):
            ids = ids.astype("<u4")
            begins = np.concatenate(([0], ends[:-1]))
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return the digests read back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id)
    return read_digests(docs.sparkSession, path)
