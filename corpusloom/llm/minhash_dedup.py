"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is its set of hashed word shingles.  The sketch has ``bands * rows``
bins and is filled in rounds: in each of the first rounds, as many as there are bins, every shingle is
hashed into one bin with a value that counts the round first, in each of as many later rounds
into the round's own bin; a bin keeps the least.  Most sets fill
all bins within a few rounds, and the later rounds fill every bin of
any set that isn't empty.  Two sets agree in a bin with a probability equal to their
similarity, concentrated as for independent bins.  With 32 bands of 5 rows a
pair at a similarity of 0.8 shares no band with a probability of 3 in a million.

Equal sets form a class, and only one document of each class goes on.  Members of a
band bucket become candidates without listing all pairs: each is first compared
with its bucket's hub, and verified links are joined to components.  What is
left are pairs of different components in one bucket.  For those the sets of the
documents in such buckets are joined exactly: shingles are ordered by
their frequency there, a pair must share one among its rarest, and the places
of that one must leave room for enough others.  A pair that is never
compared is thus in one component already, or too different.  Links are
confirmed on the full sets.

Defined results: words are runs of anything but ASCII white space, A-Z in lower
case.  A text with fewer words than a shingle is one shingle, a text without
words or a null text is empty and linked with nothing.  Rows that repeat an
id count as one document with the links of all its rows; rows with a null id are linked
with nothing and kept.  Empty tables give empty results.  Whole texts are read;
extra columns are ignored by :func:`link` and carried by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import release_memory
from corpusloom.llm.graph import components
from corpusloom.llm.storage import checked_broadcast, drop, materialize, release_shuffles

BANDS, ROWS = 32, 5
SLICE_DOCS = 128
#: Pairs of one document that are verified in one place.
PART_PAIRS = 5_000
CACHED_WORDS = 200_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(out)


def sketch(sets: list[np.ndarray], bins: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """(sets, bins) minima of the non-empty ``sets``; rows of empty sets stay unfilled."""
    out = np.full((len(sets), bins), _EMPTY)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(items):
            break
        h = _mix(items + np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF))
        value = (h >> np.uint64(16)) | np.uint64(i << 48)
        bin_ = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + bin_, value)
        open_ = (out == _EMPTY).any(axis=1)[owner]
        if not open_.all():
            items, owner = items[open_], owner[open_]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) 64-bit keys; the band's number is part of the key."""
    rows = sketches.reshape(len(sketches), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return out


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, class_key, bands``: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_DOCS):
                batch = whole.slice(at, SLICE_DOCS)
                sets = [shingles(t, k, hashes) for t in batch.column(1).to_pylist()]
                keys = band_keys(sketch(sets)).view(np.int64)
                bands = [x if len(s) else None for x, s in zip(keys, sets, strict=True)]
                classes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "class_key", "bands"]
                )
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, class_key binary, bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``id`` and ``shingles`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_DOCS):
                batch = whole.slice(at, SLICE_DOCS)
                sets = [shingles(t, k, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough.

    The sets of a document that many others are compared with go to as many parts as those fill, so no part holds more than ``PART_PAIRS`` sets of one hub's partners.
    """
    hubs = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > PART_PAIRS)
    # at most one row for each PART_PAIRS pairs
    parts = checked_broadcast(materialize(hubs.select("b", F.ceil(F.col("c") / PART_PAIRS).cast("long").alias("parts")), "hubs"))
    dealt = pairs.join(parts, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).join(parts, "b", "left")
    second = second.select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = (100 * shared) >= percent * (F.size("sa") + F.size("sb") - shared)
    return dealt.join(first, "a").join(second, ["b", "part"]).where(linked).select("a", "b")


def _similar_sizes(x: str, y: str, percent: int):
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def _rare_pairs(sets: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can be similar enough, by prefix, place and size.

    ``open_`` has ``id, n, label``.  A shingle at place ``p`` of the ``n`` in order of
    frequency leaves at most ``1 + n - p`` shared ones if it is the first that is shared.
    """
    each = sets.join(open_, "id").select("id", "n", "label", F.explode("shingles").alias("s"))
    each = materialize(each, "open-shingles")
    # a shingle of one component's documents only leads to no pair, so large groups of copies don't meet themselves
    counts = each.groupBy("s").agg(F.count("*").alias("c"), (F.min("label") != F.max("label")).alias("mixed"))
    counts = materialize(counts, "shingle-counts")
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "s"))
    placed = each.join(counts, "s").withColumn("p", place).where(F.col("mixed") & (100 * (F.col("n") - F.col("p") + 1) >= percent * F.col("n")))
    placed = materialize(placed.select("s", "id", "n", "label", "p"), "rare-shingles")
    drop(each, counts)
    x = placed.where((100 + percent) * (F.col("n") - F.col("p") + 1) >= 2 * percent * F.col("n")).select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("label").alias("la"))
    y = placed.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("label").alias("lb"))
    room = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (100 + percent) * room >= percent * (F.col("na") + F.col("nb"))
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return x.join(y, "s").where((F.col("la") != F.col("lb")) & first & (100 * F.col("na") >= percent * F.col("nb")) & fits).select("a", "b").distinct()


def _links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """``id`` and ``root`` of class representatives that are linked with others."""
    postings = reps.select(F.explode("bands").alias("key"), "id", "n")
    hub = F.min(F.struct(F.col("id").alias("b"), F.col("n").alias("nb"))).alias("hub")
    buckets = materialize(postings.groupBy("key").agg(hub, F.max("id").alias("last")).where("last <> hub.b").select("key", "hub.b", "hub.nb"), "buckets")
    members = materialize(postings.join(buckets, "key"), "members")
    wanted = checked_broadcast(materialize(members.select(F.col("id").alias("doc_id")).distinct(), "candidates"))
    sets = materialize(_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), k), "shingle-sets")
    near = members.where((F.col("id") != F.col("b")) & _similar_sizes("n", "nb", percent)).select(F.col("id").alias("a"), "b").distinct()
    links = materialize(_verified(materialize(near, "hub-pairs"), sets, percent), "hub-links")
    roots = components(links)
    labelled = materialize(members.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("label")), "labelled")
    mixed = materialize(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "mixed-buckets")
    open_ = labelled.join(mixed, "key").select("id", "n", "label").distinct()
    others = materialize(_rare_pairs(sets, open_, percent), "rare-pairs")
    linked = components(links.unionByName(_verified(others, sets, percent)))
    drop(buckets, members, sets, links, labelled, mixed, others)
    return linked


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    table = materialize(_sketched(docs, k), "sketches")
    full = table.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("class_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    roots = _links(docs, reps, k, percent)
    classes = materialize(reps.join(roots, "id", "left").select("class_key", "id", F.coalesce("root", "id").alias("component_id")), "components")
    drop(reps)
    # an id whose rows differ belongs to several classes, which its id links
    linked = full.select("doc_id", F.col("n").alias("n_shingles"), "class_key").join(classes, "class_key").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = table.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without later near-duplicates.

    Of every component the document with the smallest id stays.  Rows that share an id and differ in text
    are documents of their own, the lesser text first; of rows that repeat id and text one stays.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        verdict = materialize(link(docs, k, percent), "verdicts")
        release_shuffles(docs.sparkSession)
        gone = materialize(verdict.where(~F.col("kept")).select("doc_id").distinct(), "gone")
        drop(verdict)
        return docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    number, component = _unused("row", docs), _unused("component", docs)
    # numbers of their own for all rows but those without an id, which are linked with nothing
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).withColumn(number, F.monotonically_increasing_id())
    own = materialize(own, "numbered")
    linked = link(own.select(F.col(number).alias("doc_id"), "text"), k, percent)
    found = own.select(number, "doc_id", "text").join(linked.select(F.col("doc_id").alias(number), F.col("component_id").alias(component)), number)
    first = found.groupBy(component).agg(F.min(F.struct("doc_id", "text", number)).alias("first")).select(F.col(f"first.{number}").alias(number))
    return own.join(first, number, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def _unused(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name
