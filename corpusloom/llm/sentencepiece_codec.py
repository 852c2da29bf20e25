"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A SentencePiece BPE model is applied by an agenda of candidate merges, best
score first.  Each candidate that comes up is skipped with probability
``dropout``, on its own in every occurrence.  Skipped candidates don't come back, which
yields finer segmentations of the same text.

Which candidates an occurrence skips is drawn as the numbers of candidates between skips,
which are geometric, from a keyed hash of seed, document, place of the chunk and number
of the draw, so a run can be repeated exactly anywhere.

If no piece of the model reaches over a line end, over the space after a word or from a
letter to a mark, texts are segmented chunk by chunk, otherwise as one chunk.  The segmentation of a
chunk by the candidates that are skipped is remembered from its second occurrence on, so an occurrence looks up what it
has drawn; what is remembered changes no result.  Chunks of more than ``LONG_CHUNK`` characters are
segmented anew each time.  An occurrence without a skip has the model's own segmentation, which the
library gives; with ``dropout=0`` all do.

Defined results: null and empty texts have no ids and decode to the empty text.
Characters without a piece become byte pieces, and so does U+2581 in a text, which
the model uses for spaces: decoding gives back every text unchanged.  Repeated
rows (same id and text) are encoded alike; a null id counts as the text ``None``.  Long texts are
encoded whole.  Extra columns are carried when named in ``keep``.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import beside, release_memory

SPACE = "\u2581"
CACHED_CHUNKS = 2_000_000
LONG_CHUNK = 40
#: Chunks that are looked up together, and candidates that a remembered chunk can have.
_TOGETHER = 1 << 16
_CANDIDATES = 4 * LONG_CHUNK
#: Skips drawn at once for a chunk that isn't remembered.
_DRAWS = 4
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: A mark after a letter: no piece may hold both, so a chunk ends there too.
_MARK = re.compile(r"[.,;:!?%&$*|](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)")
_NEVER = 1 << 62


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, dropout: float, seed: int, cached_chunks: int = CACHED_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self._model = model
        self._rank: dict[str, float] = {}
        self._id: dict[str, int] = {}
        self._bytes: list[bytes] = []
        self._byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self._byte_id[int(piece[3:5], 16)] = i
                self._bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self._bytes.append(b"")
            else:
                self._id[piece] = i
                self._rank[piece] = -model.get_score(i)
                self._bytes.append(piece.replace(SPACE, " ").encode())
        self._spelled = np.array([*self._bytes, b""], object)[:-1]
        #: whether a piece may hold what would be in two chunks
        self._whole = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) or _MARK.search(p) for p in self._id)
        #: which pieces begin a character: all but the later bytes of one
        self._begins = [1] * len(self._bytes)
        for byte in range(0x80, 0xC0):
            self._begins[self._byte_id[byte]] = 0
        self._dropout = dropout
        self._scale = 1 / math.log1p(-dropout) if 0 < dropout < 1 else -0.0
        self._seed = seed
        self._most = cached_chunks
        self.forget()

    def forget(self) -> None:
        """Remember nothing.

        Nodes are segmentations: of a chunk without skips, or of a parent's chunk with one skip more.

        Node 0 stands for chunks that aren't remembered.
        """
        self._known: dict[str, int] = {}
        self._children: dict[int, int] = {}
        self._data = np.full(1 << 16, b"", object)
        self._chunk: list[str] = [""]
        self._count, self._parent, self._skip = array("q", [0]), array("q", [0]), array("q", [0])

    def _add(self, chunk: str, parent: int, skip: int, ids: list[int], count: int) -> int:
        node = len(self._chunk)
        if node == len(self._data):
            self._data = np.concatenate((self._data, np.full(node, b"", object)))
        self._data[node] = _packed(ids)
        self._chunk.append(chunk)
        self._count.append(count)
        self._parent.append(parent)
        self._skip.append(skip)
        return node

    def _child(self, key: int) -> int:
        node, skip = divmod(key, _CANDIDATES)
        skips, at = [skip], node
        while self._skip[at] >= 0:
            skips.append(self._skip[at])
            at = self._parent[at]
        chunk = self._chunk[node]
        self._children[key] = found = self._add(chunk, node, skip, *self.segment(chunk, skips[::-1]))
        return found

    def _own(self, chunks: list[str]) -> list[tuple[list[int], int]]:
        """Like :meth:`segment` without skips, of many chunks, which the library does for words after one space."""
        words = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and c[1] != " " and SPACE not in c]
        out: list = [None] * len(chunks)
        for i, ids in zip(words, self._model.encode([chunks[i][1:] for i in words], num_threads=1), strict=True):
            # each candidate is a merge here, and so makes one symbol less
            out[i] = ids, len(chunks[i]) - sum(map(self._begins.__getitem__, ids))
        return [self.segment(c) if found is None else found for c, found in zip(chunks, out, strict=True)]

    def _gaps(self, keys: np.ndarray, draw: int | np.ndarray) -> np.ndarray:
        """How many candidates come up before the next skip."""
        hashed = _mixed(keys ^ _mixed(np.atleast_1d(np.asarray(draw, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)))
        uniform = ((hashed >> np.uint64(11)) + 0.5) * 2.0**-53
        return np.minimum(np.log(uniform) * self._scale, float(1 << 40)).astype(np.int64)

    def _skips(self, key: np.uint64, first: list[int]) -> Iterator[int]:
        """The candidates that one occurrence skips, ascending, of which the ``first`` ones are drawn."""
        yield from first
        at, draw = first[-1], len(first)
        while True:
            for gap in self._gaps(np.full(64, key), np.arange(draw, draw + 64)).tolist():
                at += 1 + gap
                yield at
            draw += 64

    def segment(self, chunk: str, skips: Iterable[int] = ()) -> tuple[list[int], int]:
        """Ids of one chunk, in which a space is a space, and how many candidates came up; ``skips`` are the numbers of those to skip, ascending."""
        if len(chunk) <= LONG_CHUNK and SPACE not in chunk:
            return self._segment_short(chunk.replace(" ", SPACE), skips)
        symbols: list[str | None] = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in chunk]
        n = len(symbols)
        rank, ids = self._rank, self._id
        ahead = iter(skips)
        skip, count = next(ahead, _NEVER), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in rank:
                agenda.append((rank[piece], i, piece))
        heapify(agenda)
        while agenda:
            cost, i, piece = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or left + symbols[j] != piece:
                continue
            count += 1
            if count > skip:
                skip = next(ahead, _NEVER)
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                more = piece + symbols[k]
                if more in rank:
                    heappush(agenda, (rank[more], i, more))
            h = before[i]
            if h >= 0:
                more = symbols[h] + piece
                if more in rank:
                    heappush(agenda, (rank[more], h, more))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += [self._byte_id[b] for b in s.removeprefix("\0" if len(s) > 1 else "").encode()]
        return out, count

    def _segment_short(self, text: str, skips: Iterable[int]) -> tuple[list[int], int]:
        """Few symbols need no heap: the agenda is the list of the neighbours' costs, of which the first least one comes up."""
        cost, ids = self._rank.get, self._id
        symbols = list(text)
        agenda = [cost(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        ahead = iter(skips)
        skip, count = next(ahead, _NEVER), 0
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            count += 1
            if count > skip:
                skip = next(ahead, _NEVER)
                agenda[i] = _NEVER
                continue
            symbols[i] = piece = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(piece + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + piece, _NEVER)
        out: list[int] = []
        for s in symbols:
            if s in ids:
                out.append(ids[s])
            else:
                out += [self._byte_id[b] for b in s.encode()]
        return out, count

    def _chunks(self, text: str) -> list[str]:
        if self._whole:
            return [" " + text]
        if "  " in text or "\0" in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return _CHUNK.findall(" " + text)
        return _MARK.sub(r"\0\g<0>", " " + text).replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _encoded(self, chunks: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of chunks, each with the key of its occurrence."""
        if len(self._chunk) + len(self._known) > self._most:
            self.forget()
        known = self._known
        at = np.fromiter(map(known.get, chunks, repeat(0)), np.int64, len(chunks))
        anew, again = [], []
        if not at.all():
            for i in np.flatnonzero(at == 0).tolist():
                chunk = chunks[i]
                # a chunk is remembered when it comes again
                if len(chunk) <= LONG_CHUNK and chunk in known:
                    again.append(i)
                else:
                    if len(chunk) <= LONG_CHUNK:
                        known[chunk] = 0
                    anew.append(i)
            fresh = [c for c in dict.fromkeys(chunks[i] for i in again) if not known[c]]
            for chunk, own in zip(fresh, self._own(fresh), strict=True):
                known[chunk] = self._add(chunk, 0, -1, *own)
            at[again] = [known[chunks[i]] for i in again]
        if self._dropout > 0:
            open_ = np.arange(len(chunks))
            skip = self._gaps(keys, 0)
            draw = 0
            while True:
                hit = skip < np.frombuffer(self._count, np.int64)[at[open_]]
                open_, skip = open_[hit], skip[hit]
                if not open_.size:
                    break
                wanted = (at[open_] * _CANDIDATES + skip).tolist()
                found = list(map(self._children.get, wanted))
                if None in found:
                    for i, child in enumerate(found):
                        if child is None:
                            found[i] = self._children.get(wanted[i]) or self._child(wanted[i])
                at[open_] = found
                draw += 1
                skip = skip + 1 + self._gaps(keys[open_], draw)
        out = self._data[at].tolist()
        if anew and self._dropout > 0:
            own = keys[anew]
            skips = (np.cumsum(1 + np.stack([self._gaps(own, draw) for draw in range(_DRAWS)], axis=1), axis=1) - 1).tolist()
            plain = []
            for i, few in zip(anew, skips, strict=True):
                # a chunk has fewer candidates than characters
                if few[0] >= len(chunks[i]) - 1 and len(chunks[i]) <= LONG_CHUNK:
                    plain.append(i)
                else:
                    out[i] = _packed(self.segment(chunks[i], self._skips(keys[i], few))[0])
        else:
            plain = anew
        for i, (ids, _) in zip(plain, self._own([chunks[i] for i in plain]), strict=True):
            out[i] = _packed(ids)
        return out

    def encode_all(self, doc_ids: list[object], texts: list[str | None]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        out: list[bytes] = []
        waiting: list[str] = []
        keys: list[int] = []
        ends: list[int] = []

        def flush() -> None:
            sizes = np.diff([0, *ends])
            place = np.arange(len(waiting), dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
            own = _mixed(place * np.uint64(0x9E3779B97F4A7C15) + np.repeat(np.array(keys, np.uint64), sizes))
            found = self._encoded(waiting, own) if waiting else []
            out.extend(b"".join(found[a:b]) for a, b in zip([0, *ends], ends))
            waiting.clear(), keys.clear(), ends.clear()

        for doc_id, text in zip(doc_ids, texts, strict=True):
            if text:
                waiting += self._chunks(text)
            # every chunk has a key of its own: of the document's and its place in it
            keys.append(xxhash.xxh3_64_intdigest(f"{self._seed}:{doc_id}"))
            ends.append(len(waiting))
            if len(waiting) >= _TOGETHER:
                flush()
        flush()
        return out

    def encode(self, doc_id: object, text: str | None) -> bytes:
        """Little-endian u32 ids of a text."""
        return self.encode_all([doc_id], [text])[0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ``ids``; the space that encoding puts first is taken off."""
        return b"".join(self._spelled[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")[1:]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, dropout: float = 0.1, seed: int = 0, cached_chunks: int = CACHED_CHUNKS) -> Codec:
    """One codec per worker process and setting."""
    key = (path, dropout, seed, cached_chunks)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, keep: tuple[str, ...] = ("doc_id",), cached_chunks: int = CACHED_CHUNKS, forget: bool = False) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``ids``, their ``n_tokens`` and ``ids_crc32``, and
    whether decoding them gave back the text (``lossless``).

    With ``forget`` a task leaves nothing remembered behind, so that the workers' memory is free for other operators.
    """
    source, columns = beside(docs, ["doc_id", "text"], keep)
    empty = F.array().cast("array<int>")
    schema = source.select("row", empty.alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("lossless")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, dropout, seed, cached_chunks)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                doc_ids, texts = (c.to_pylist() for c in columns(batch))
                found = own.encode_all(doc_ids, texts)
                lossless = [own.decode(np.frombuffer(x, "<u4")) == (t or "") for x, t in zip(found, texts, strict=True)]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("row"), ids, pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(lossless)], schema.fieldNames())
        if forget:
            own.forget()
        release_memory()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns) and the ``text`` of the column ``ids``."""
    source = encoded.select("ids", F.struct(*keep).alias("row"))
    schema = source.select("row", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, 0.0)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["row", "text"])

    return source.mapInArrow(run, schema)
