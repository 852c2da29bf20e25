"""Anchor pairs counted in Arrow batches: the same keys as :func:`corpusloom.operators.patterns.anchor_pairs` gives, as numbers.

A pair's key is two anchors and a range of gaps, so it is a number until it has been counted, and what a task found
of a key is summed before it is shuffled.  A realization is told by a 64-bit hash of its tokens, the difference of
two running sums; its text is put together only where it is asked for, and of the first ones of a key only
those that may be among them.  Tokens are not null.  Of all pairs at hand no more than a batch's are held, and of
sums and first realizations ``HELD`` rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusloom.functions.keys import escape

#: Rows that a task holds before it hands them on.
HELD = 600_000
#: Parts that hashes are dealt to, by their first bits, and hashes that a task holds.
PARTS, HELD_HASHES = 4096, 1_500_000
#: Tokens whose pairs are found at once.
TOKENS = 300_000
#: Upper bounds of the ranges of gaps, as :func:`corpusloom.functions.keys.gap_bucket` has them.
_BOUNDS, _RANGES = (0, 1, 3, 7), ("0", "1", "2-3", "4-7", "8+")
#: 5 modulo 8, so that differences of its powers hold few factors 2.
_BASE = 6364136223846793005


class _Found(NamedTuple):
    """Pairs of a batch: the row of each, its code, the places of its anchors among all tokens, and the tokens."""

    row: np.ndarray
    code: np.ndarray
    first: np.ndarray
    last: np.ndarray
    tokens: pa.Array
    ids: np.ndarray
    words: pa.Array
    starts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash of each pair's tokens, both anchors included."""
        n = len(self.ids)
        of_word = pd.util.hash_array(np.asarray(self.words.to_pylist(), dtype=object), categorize=False) if len(self.words) else np.zeros(0, "uint64")
        power = np.multiply.accumulate(np.concatenate([np.ones(1, "uint64"), np.full(n, _BASE, "uint64")]))
        back = np.multiply.accumulate(np.concatenate([np.ones(1, "uint64"), np.full(n, pow(_BASE, -1, 1 << 64), "uint64")]))
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(of_word[self.ids] * power[:n], dtype="uint64")])
        return ((sums[self.last + 1] - sums[self.first]) * back[self.first]).view("int64")

    def texts(self, chosen: np.ndarray) -> np.ndarray:
        listed = self.tokens.to_pylist()
        return np.array([" ".join(listed[a : b + 1]) for a, b in zip(self.first[chosen].tolist(), self.last[chosen].tolist())], dtype=object)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of ``TOKENS`` tokens or one sentence."""
    ends = batch.column("tokens").offsets.to_numpy().astype("int64")
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def _pairs(batch: pa.RecordBatch, anchors: list[str], max_gap: int) -> _Found:
    lists = batch.column("tokens")
    starts = lists.offsets.to_numpy().astype("int64")
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    encoded = flat.dictionary_encode()
    words, ids = encoded.dictionary, encoded.indices.to_numpy()
    known = pc.fill_null(pc.index_in(words, value_set=pa.array(anchors, words.type)), -1).to_numpy().astype("int64")
    anchor = known[ids] if len(known) else np.zeros(0, "int64")
    at = np.flatnonzero(anchor >= 0)
    row = np.searchsorted(starts, at, side="right") - 1
    first, last = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for k in range(1, min(max_gap + 1, len(at) - 1) + 1):
        near = np.flatnonzero((at[k:] - at[:-k] <= max_gap + 1) & (row[k:] == row[:-k]))
        if not len(near):
            break
        first.append(near)
        last.append(near + k)
    a, b = np.concatenate(first), np.concatenate(last)
    gap = np.searchsorted(_BOUNDS, at[b] - at[a] - 1)
    code = (anchor[at[a]] * len(anchors) + anchor[at[b]]) * len(_RANGES) + gap
    return _Found(row[a], code, at[a], at[b], flat, ids, words, starts)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Columns ``code`` and sums, added up by code."""
    codes, at = np.unique(rows[0], return_inverse=True)
    out = np.zeros((len(rows), len(codes)), "int64")
    out[0] = codes
    for own, column in zip(out[1:], rows[1:]):
        np.add.at(own, at, column)
    return out


def _counted(found: _Found, own: np.ndarray, n_codes: int) -> np.ndarray:
    """``code``, occurrences and sentences, and those of ``own`` sentences."""
    each, n = np.unique(found.row * n_codes + found.code, return_counts=True)
    mine = own[each // n_codes]
    return _summed(np.stack([each % n_codes, n, np.ones_like(n), n * mine, mine]))


def _firsts(code: np.ndarray, h: np.ndarray, places: tuple[np.ndarray, ...], cap: int) -> np.ndarray:
    """Which rows are the first of their code and hash, and of those the first ``cap`` of each code (0: all)."""
    ordered = np.lexsort((*reversed(places), code))
    code, h = code[ordered], h[ordered]
    alike = np.lexsort((h, code))  # keeps the order of equal ones
    new = np.ones(len(alike), bool)
    new[1:] = (code[alike][1:] != code[alike][:-1]) | (h[alike][1:] != h[alike][:-1])
    kept = np.sort(alike[new])
    if cap > 0:
        own = code[kept]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, "int64")
        kept = kept[np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own)))) < cap]
    return ordered[kept]


def _mixed(code: np.ndarray, h: np.ndarray) -> np.ndarray:
    return h.view("uint64") ^ (code.astype("uint64") * np.uint64(_BASE))


class _First:
    """The first realizations of each code that a task has met."""

    def __init__(self, cap: int):
        self.cap, self.waiting, self.n = cap, [], 0
        self._empty()

    def _empty(self) -> None:
        self.kept = [np.zeros(0, t) for t in ("int64", "int64", "int64", "int64", "int64", object)]
        self.full, self.worst = np.zeros(0, "int64"), np.zeros(0, "int64")
        self.mixed, self.at = np.zeros(0, "uint64"), np.zeros(0, "int64")

    def add(self, found: _Found, sid: np.ndarray) -> None:
        sids = sid[found.row]
        hopeful = np.arange(len(sids))
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, found.code), len(self.full) - 1)
            hopeful = np.flatnonzero((self.full[at] != found.code) | (sids <= self.worst[at]))
        if not len(hopeful):
            return
        h = found.hashes()
        if len(self.mixed):
            # not one that is kept with an earlier place
            mixed = _mixed(found.code[hopeful], h[hopeful])
            near = self.at[np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)]
            known = (self.kept[0][near] == found.code[hopeful]) & (self.kept[1][near] == h[hopeful]) & (self.kept[2][near] < sids[hopeful])
            hopeful = hopeful[~known]
            if not len(hopeful):
                return
        # within its own sentence
        first, last = found.first - found.starts[found.row], found.last - found.starts[found.row]
        columns = [x[hopeful] for x in (found.code, h, sids, first, last)]
        best = _firsts(columns[0], columns[1], tuple(columns[2:]), self.cap)
        self.waiting.append([*[x[best] for x in columns], found.texts(hopeful[best])])
        self.n += len(best)
        if self.n > max(100_000, len(self.kept[0])):
            self.merge()

    def merge(self) -> None:
        columns = [np.concatenate(x) for x in zip(self.kept, *self.waiting)]
        best = _firsts(columns[0], columns[1], tuple(columns[2:5]), self.cap)
        self.kept, self.waiting, self.n = [x[best] for x in columns], [], 0
        mixed = _mixed(*self.kept[:2])
        self.at = np.argsort(mixed)
        self.mixed = mixed[self.at]
        if not self.cap:
            return
        code = self.kept[0]
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], len(code) > 0))
        sizes = np.diff(np.concatenate([[-1], ends]))
        # neighbours have one realization
        many = ends[(sizes >= self.cap) | (code[ends] % len(_RANGES) == 0)]
        self.full, self.worst = code[many], self.kept[2][many]

    def take(self) -> list[np.ndarray]:
        self.merge()
        out = self.kept
        self._empty()
        return out


def _packed(codes: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct codes and hashes in order, a row of numbers for each part."""
    code, h = np.concatenate(codes), np.concatenate(hashes)
    part = (h.view("uint64") >> np.uint64(64 - PARTS.bit_length() + 1)).astype("int64")
    ordered = np.lexsort((h, code, part))
    code, h, part = code[ordered], h[ordered], part[ordered]
    new = np.ones(len(h), bool)
    new[1:] = (code[1:] != code[:-1]) | (h[1:] != h[:-1])
    code, h, part = code[new], h[new], part[new]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, "int64")
    ends = np.append(begins[1:], len(part))
    step = code.copy()
    step[1:] -= code[:-1]
    step[begins] = code[begins]
    # steps of codes are small, and an own column of them packs well
    rows = [(zlib.compress(step[a:b].tobytes(), 1), h[a:b].tobytes()) for a, b in zip(begins, ends)]
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        arrays = {"part": pa.array(part[begins[at : at + 512]], pa.int64()), "steps": pa.array([x for x, _ in some], pa.binary()), "hashes": pa.array([x for _, x in some], pa.binary())}
        yield pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else pa.nulls(len(some), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _of_part(table: pa.Table) -> pa.Table:
    """Sums of a part's counts, or how many different hashes its rows hold for each code."""
    if table.column("part")[0].as_py() < 0:
        code, o, s = _summed(np.stack([table.column(c).to_numpy() for c in ("code", "o", "s")]))
        return pa.table({"code": code, "o": o, "s": s, "n_realizations": np.zeros_like(o)})
    codes, hashes = [], []
    for steps, h in zip(table.column("steps").to_pylist(), table.column("hashes").to_pylist()):
        hashes.append(np.frombuffer(h, "int64"))
        codes.append(np.cumsum(np.frombuffer(zlib.decompress(steps), "int64")))
    code, h = np.concatenate(codes), np.concatenate(hashes)
    ordered = np.lexsort((h, code))
    code, h = code[ordered], h[ordered]
    new = np.ones(len(h), bool)
    new[1:] = (code[1:] != code[:-1]) | (h[1:] != h[:-1])
    found, n = np.unique(code[new], return_counts=True)
    none = np.zeros(len(found), "int64")
    return pa.table({"code": found, "o": none, "s": none, "n_realizations": n.astype("int64")})


_SCHEMA = pa.schema([(x, pa.int64()) for x in ("code", "o", "s", "own_o", "own_s", "sid", "first", "last", "part")] + [("realization", pa.string()), ("steps", pa.binary()), ("hashes", pa.binary())])
_DDL = ", ".join(f"{f.name} { {pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'}[f.type]}" for f in _SCHEMA)


def _batches(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(columns["code"])
    for at in range(0, n, 50_000):
        part = {k: v[at : at + 50_000] for k, v in columns.items()}
        size = len(part["code"])
        yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) if f.name in part else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def scan(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20, own: Column | None = None, counts: bool = False, hashes: bool = False, first: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """What one pass over sentences with ``tokens`` finds of their pairs, by ``code``; a task's rows, still to be put together.

    ``counts`` asks for occurrences and sentences (``o, s``, and ``own_o, own_s`` of the sentences that ``own`` tells), ``hashes`` for
    the hashes of realizations, packed by their part, of all pairs but neighbours, which have one each, and ``first`` for ``realization``: the first so many of each key by
    ``sid, first, last`` (0: all).  ``only`` names the codes wanted of those.
    """
    listed = sorted(set(anchors))
    n_codes = len(listed) ** 2 * len(_RANGES)
    wanted = None if only is None else np.array(sorted(only), "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n_sums, held = [], 0, _First(first or 0)
        codes, marks, n_marks = [], [], 0
        named = lambda x: dict(zip(("code", "o", "s", "own_o", "own_s"), x))
        texts = lambda x: dict(zip(("code", "sid", "first", "last", "realization"), (x[0], *x[2:])))
        for batch in (part for whole in batches for part in _parts(whole)):
            found = _pairs(batch, listed, max_gap)
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            if counts and len(found.code):
                sums.append(_counted(found, batch.column("own").to_numpy(zero_copy_only=False).astype("int64"), n_codes))
                n_sums += sums[-1].shape[1]
                if n_sums > HELD:
                    sums = [_summed(np.concatenate(sums, axis=1))]
                    n_sums = sums[0].shape[1]
                    if n_sums > HELD / 2:
                        yield from _batches(**named(sums[0]))
                        sums, n_sums = [], 0
            if hashes:
                apart = found.code % len(_RANGES) > 0
                codes.append(found.code[apart])
                marks.append(found.hashes()[apart])
                n_marks += len(codes[-1])
                if n_marks > HELD_HASHES:
                    yield from _packed(codes, marks)
                    codes, marks, n_marks = [], [], 0
            if first is not None:
                if wanted is not None:
                    mine = np.isin(found.code, wanted)
                    found = found._replace(**{k: getattr(found, k)[mine] for k in ("row", "code", "first", "last")})
                held.add(found, sid)
                if len(held.kept[0]) + held.n > HELD or not first and held.n > HELD // 6:
                    yield from _batches(**texts(held.take()))
        if n_marks:
            yield from _packed(codes, marks)
        if sums:
            yield from _batches(**named(_summed(np.concatenate(sums, axis=1))))
        if first is not None:
            yield from _batches(**texts(held.take()))

    sid = F.col("sid").cast("long") if "sid" in sentences.columns else F.lit(0).cast("long")
    return sentences.select(sid.alias("sid"), "tokens", F.coalesce(own if own is not None else F.lit(False), F.lit(False)).alias("own")).mapInArrow(run, _DDL)


def _by_first(found: _Found) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order of their places, and where those of one first anchor begin among them."""
    ordered = np.lexsort((found.last, found.first))
    first = found.first[ordered]
    return ordered, np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, "int64")


def windows(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20) -> DataFrame:
    """``text, ends, codes``: the tokens from an anchor to the last one that it makes a pair with, and a space.

    All realizations that begin there are the beginnings of this text that end in an anchor.  ``ends`` and ``codes`` tell them where tokens
    with spaces hide them.  A task names a text once while it remembers it.
    """
    listed = sorted(set(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for batch in (part for whole in batches for part in _parts(whole)):
            found = _pairs(batch, listed, max_gap)
            spaced = pc.or_(pc.match_substring(found.words, " "), pc.equal(found.words, "")).to_numpy(zero_copy_only=False)
            odd = np.concatenate([[0], np.cumsum(spaced[found.ids])]) if len(found.ids) else np.zeros(1, "int64")
            ordered, begins = _by_first(found)
            stops = np.append(begins[1:], len(ordered))  # one without a beginning, if there are no pairs
            # the last pair of an anchor reaches farthest
            first, last = found.first[ordered[begins]], found.last[ordered[stops[: len(begins)] - 1]]
            tokens = found.tokens.to_pylist()
            texts, ends, codes = [], [], []
            for a, b, is_odd, at, to in zip(first.tolist(), last.tolist(), (odd[last + 1] > odd[first]).tolist(), begins.tolist(), stops.tolist()):
                text = " ".join(tokens[a : b + 1]) + " "
                if not is_odd:
                    if text in met:
                        continue
                    met.add(text)
                    ends.append(None)
                    codes.append(None)
                else:
                    pairs = ordered[at:to]
                    ends.append([len(" ".join(tokens[a : z + 1])) for z in found.last[pairs].tolist()])
                    codes.append(found.code[pairs].tolist())
                texts.append(text)
            if len(met) > HELD // 4:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ends, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int64()))], ["text", "ends", "codes"])

    return sentences.select("tokens").mapInArrow(run, "text string, ends array<int>, codes array<bigint>")


def _prefixes(listed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct ``code, realization`` of windows in order of their texts; lists of plain ones are empty.

    Texts that begin alike follow each other, so what the last one has in common with the next is all that is remembered.
    """
    number = {t: i for i, t in enumerate(listed)}
    ranges = np.searchsorted(_BOUNDS, np.arange(10)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ""
        # end, tokens up to there, and code of the realizations that the last text begins with
        open_: list[tuple[int, int, int]] = []
        for batch in batches:
            codes, out = [], []
            texts = batch.column(0).to_pylist()
            given = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if len(batch.column(1).flatten()) else [None] * len(texts)
            for text, listing in zip(texts, given):
                if text == last and (listing is None or not listing[0]):
                    if all(n for _, n, _ in open_):
                        continue
                while open_ and not text.startswith(last[: open_[-1][0] + 1]):
                    open_.pop()
                last = text
                if listing is not None and listing[0]:
                    known = {(e, c) for e, _, c in open_}
                    for e, c in zip(*listing):
                        if (e, c) not in known:
                            codes.append(c)
                            out.append(text[:e])
                            # the number of tokens isn't told by the text
                            open_.append((e, 0, c))
                    open_.sort()
                    continue
                plain = all(n for _, n, _ in open_)
                known = () if plain else {(e, c) for e, _, c in open_}
                at, n = (open_[-1][0] + 1, open_[-1][1]) if open_ and plain else (text.index(" ") + 1, 1)
                base = number[text[: text.index(" ")]] * len(listed)
                for token in text[at:-1].split(" ") if at < len(text) else ():
                    end, n = at + len(token), n + 1
                    i = number.get(token)
                    if i is not None:
                        code = (base + i) * len(_RANGES) + (ranges[n - 2] if n < 12 else len(_RANGES) - 1)
                        if plain or (end, code) not in known:
                            codes.append(code)
                            out.append(text[:end])
                            open_.append((end, n, code))
                    at = end + 1
                if not plain:
                    open_.sort()
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(out, pa.string())], ["code", "realization"])

    return run


def with_keys(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20) -> DataFrame:
    """Sentences and ``patterns``, the keys of their pairs in the order of :func:`corpusloom.operators.patterns.anchor_pairs`."""
    listed = sorted(set(anchors))
    names = [re.sub(r"([\\|,=])", r"\\\1", t) for t in listed]

    def key(code: int) -> str:
        pair, gap = divmod(code, len(_RANGES))
        a, b = divmod(pair, len(listed))
        return f"anch_pair|a={names[a]},{names[b]}|p=gap={_RANGES[gap]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            found = _pairs(batch, listed, max_gap)
            ordered, _ = _by_first(found)
            each, at = np.unique(found.code[ordered], return_inverse=True)
            keys = pa.array([key(c) for c in each.tolist()], pa.string()).take(pa.array(at))
            offsets = np.searchsorted(found.row[ordered], np.arange(batch.num_rows + 1)).astype("int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), keys)], [*batch.schema.names, "patterns"])

    return sentences.mapInArrow(run, StructType([*sentences.schema.fields, StructField("patterns", ArrayType(StringType()))]))


def key_of(code: Column, anchors: Iterable[str]) -> Column:
    """The key that a code stands for."""
    listed = sorted(set(anchors))
    names = F.array(*[escape(F.lit(t)) for t in listed]).cast("array<string>")
    over = lambda x, by: F.call_function("div", x, F.lit(by).cast("long"))
    pick = lambda values, at: F.element_at(values, (at + 1).cast("int"))
    pair = over(code, len(_RANGES))
    ranges = F.array(*[F.lit(x) for x in _RANGES])
    return F.concat(F.lit("anch_pair|a="), pick(names, over(pair, len(listed))), F.lit(","), pick(names, pair % len(listed)), F.lit("|p=gap="), pick(ranges, code % len(_RANGES)))


def codes_of(keys: Iterable[str], anchors: Iterable[str]) -> dict[str, int]:
    """The codes of a bounded list of keys; those that are no pair of the anchors have none."""
    listed = sorted(set(anchors))
    escaped = {}
    for i, token in enumerate(listed):
        for mark in ("\\", "|", ",", "="):
            token = token.replace(mark, "\\" + mark)
        escaped[token] = i
    out = {}
    for key in keys:
        head, _, gap = key.rpartition("|p=gap=")
        body = head.removeprefix("anch_pair|a=")
        for at in (i for i, c in enumerate(body) if c == ","):
            a, b = escaped.get(body[:at]), escaped.get(body[at + 1 :])
            if head.startswith("anch_pair|a=") and gap in _RANGES and a is not None and b is not None:
                out[key] = (a * len(listed) + b) * len(_RANGES) + _RANGES.index(gap)
    return out


def counts_of(found: DataFrame, anchors: Iterable[str], own: bool = False) -> DataFrame:
    """``pattern_key, count_occurrences, count_sentences`` of a scan, with ``own`` also the own ones."""
    columns = {"o": "count_occurrences", "s": "count_sentences"} | ({"own_o": "own_occurrences", "own_s": "own_sentences"} if own else {})
    sums = found.where("o IS NOT NULL").groupBy("code").agg(*[F.sum(c).alias(name) for c, name in columns.items()])
    return sums.select(key_of(F.col("code"), anchors).alias("pattern_key"), *columns.values())


def key_counts(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20, own: Column | None = None) -> DataFrame:
    """As :func:`corpusloom.operators.statistics.key_counts`, of the pairs of sentences with ``tokens``."""
    listed = list(anchors)
    return counts_of(scan(sentences, listed, max_gap, own, counts=True), listed, own is not None)


def pattern_counts(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20) -> DataFrame:
    """As :func:`corpusloom.operators.statistics.pattern_counts`: also ``n_realizations``."""
    listed = list(anchors)
    found = scan(sentences, listed, max_gap, counts=True, hashes=True)
    # counts go to the part that their code falls to
    rows = found.select(F.coalesce("part", -1 - F.col("code") % PARTS).alias("part"), "code", "o", "s", "steps", "hashes")
    each = rows.groupBy("part").applyInArrow(_of_part, "code long, o long, s long, n_realizations long")
    n = F.when(F.col("code") % len(_RANGES) == 0, F.lit(1).cast("long")).otherwise(F.sum("n_realizations"))
    sums = each.groupBy("code").agg(F.sum("o").alias("count_occurrences"), F.sum("s").alias("count_sentences"), n.alias("n_realizations"))
    return sums.select(key_of(F.col("code"), listed).alias("pattern_key"), "count_occurrences", "count_sentences", "n_realizations")


def first_texts(found: DataFrame, cap: int = 0) -> DataFrame:
    """``code, realization`` of a scan that asked for the first ``cap`` of each key (0: all)."""
    filled = found.where("realization IS NOT NULL")
    if cap <= 0:
        return filled.select("code", "realization").distinct()
    each = filled.groupBy("code", "realization").agg(F.min(F.struct("sid", "first", "last")).alias("at"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("at"))).where(F.col("n") <= cap).select("code", "realization")


def pattern_counts_of(found: DataFrame, texts: DataFrame, anchors: Iterable[str]) -> DataFrame:
    """``pattern_key, count_occurrences, count_sentences, n_realizations`` of a scan that asked for counts, and of its ``code, realization``; texts aren't shuffled."""
    rows = found.where("o IS NOT NULL").select("code", "o", "s", F.lit(0).alias("r")).unionByName(texts.select("code", F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("s"), F.lit(1).alias("r")))
    sums = rows.groupBy("code").agg(F.sum("o").alias("count_occurrences"), F.sum("s").alias("count_sentences"), F.sum("r").alias("n_realizations"))
    return sums.select(key_of(F.col("code"), anchors).alias("pattern_key"), "count_occurrences", "count_sentences", "n_realizations")


def named(texts: DataFrame, anchors: Iterable[str]) -> DataFrame:
    """``pattern_key, realization`` of ``code, realization``."""
    return texts.select(key_of(F.col("code"), anchors).alias("pattern_key"), "realization")


def realizations(sentences: DataFrame, anchors: Iterable[str], max_gap: int = 20, cap: int = 0, keys: Iterable[str] | None = None) -> DataFrame:
    """Distinct realizations of each key, or of a bounded list of ``keys``: the first ``cap`` in order of the corpus (0: all)."""
    listed = list(anchors)
    if keys is None and cap <= 0:
        found = windows(sentences, listed, max_gap).repartition(F.substring_index("text", " ", 2)).sortWithinPartitions("text")
        # the engine measures a batch with each row that it adds, and goes through all lists that are null then
        filled = found.select("text", *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("ends", "codes")])
        texts = filled.mapInArrow(_prefixes(sorted(set(listed))), "code long, realization string")
        return named(texts, listed)
    only = None if keys is None else codes_of(keys, listed).values()
    return named(first_texts(scan(sentences, listed, max_gap, first=cap, only=only), cap), listed)
