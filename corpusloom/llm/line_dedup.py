"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words.  A line is removed if an earlier
line, by document id and then place, has a Jaccard similarity of at least 0.8
with it; whether that earlier line is itself removed makes no difference.

Words are ordered by rarity: one pass counts in how many lines of all texts words occur, in a
sketch of a fixed number of slots, and a word ranks by its slot's count (on a scale of
thirds of powers of two), then by hash.  Any order gives the same result;
this one puts words that few lines have in front.  Lines with equal sets form
a class, in which only the first goes on.  Two similar lines share a word
among their first ones (prefix filter), have similar sizes (length filter), enough
room behind the shared word (positional filter), and differ in few words:
128 bits of parity over all words differ in at most as many places.  Before that, a
line is compared with the earliest one that has one of its three smallest hashes in common,
so most members of a group of similar lines are decided without listing
the group's pairs; only the others are joined with all earlier lines, and of their candidates
the one of the closest parity is verified first.  All candidates that could still
matter are verified on the full sets.  The join reads one shuffle of narrow rows from
both sides, its keys are words within bands of sizes, and it tests first what most pairs fail.

Defined results: lines end at line feeds; blank lines and lines of fewer than
``min_words`` different words stay.  Words are what spaces separate.  Null texts stay null and have no lines, empty ones have one
blank line.  Words are compared by a 64-bit hash.  Rows that repeat an id
count as one document: their lines of the same number share their fate.  A null id comes before
all others.
Empty tables give empty results.  Extra columns are carried by
:func:`remove_later`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.storage import checked_broadcast, drop, materialize, release_shuffles

SLOT_BITS = 18
_SLOTS = 1 << SLOT_BITS
#: Groups by smallest hash that a line belongs to.
HUBS = 3
#: Bits of the key of a word; a clash only adds candidates.
KEY_BITS = 54


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Within, the session has these settings."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _bloom_filters(spark: SparkSession):
    """Within, joins drop rows before their shuffle by Bloom filters of a fixed largest size."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    return _settings(spark, {prefix + "enabled": "true", prefix + "applicationSideScanSizeThreshold": "1", prefix + "creationSideThreshold": "1g"})


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(_SLOTS - 1)).cast("int")


def rarity_table(sets: DataFrame) -> list[int]:
    """Per slot three times the binary logarithm of how often a line has a word that falls into it."""
    # all slots fit into the aggregation's fast map
    with _settings(sets.sparkSession, {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": str(SLOT_BITS)}):
        counts = sets.select(F.explode("s").alias("x")).groupBy(_slot(F.col("x")).alias("slot")).count().collect()
    table = [0] * _SLOTS
    for slot, n in counts:
        table[slot] = min(126, int(3 * math.log2(n)))
    return table


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _word_hashes(line: Column) -> Column:
    """What spaces separate as 64-bit hashes, at least one."""
    return F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))


def _word_set(line: Column) -> Column:
    """Distinct words as 64-bit hashes."""
    return F.array_remove(F.array_distinct(_word_hashes(line)), F.xxhash64(F.lit("")))


def _prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / F.lit(100.0)).cast("int") + 1


def _line_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, line_no, s``: of every line how many its text has and its distinct words as hashes, ascending.

    The hashes are a projection of their own, so that they are told apart and sorted as primitive arrays;
    they are named twice, or the projections would become one.
    """
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
    # beside the explosion it would be counted anew for every line
    texts = docs.select("doc_id", "text", (ends + 1).alias("n_lines"))
    lines = texts.select("doc_id", "n_lines", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hashed = lines.select("doc_id", "n_lines", "line_no", _word_hashes(F.col("line")).alias("h"))
    words = F.sort_array(F.array_except("h", F.array(F.xxhash64(F.lit("")))))
    return hashed.select("doc_id", "n_lines", "line_no", F.when(F.size("h") > 0, words).alias("s"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_lines, line_no, h1, n, b1, b2, least, prefix`` of every line.

    Sorting and slicing are projections of their own, so that they run on primitive arrays.
    """
    table = F.from_json(F.lit(str(rarity_table(sets))), "array<int>")
    zero = F.lit(0).cast("long")
    # rarity above, the hash's other bits below
    ranked = lambda x: F.coalesce(F.shiftleft(F.get(table, _slot(x)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8)), zero)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda words: F.aggregate(words, zero, lambda acc, x: acc.bitwiseXOR(bit(x)))
    # negative hashes end where a zero would stand
    middle = F.array_position(F.sort_array(F.array_append("s", zero)), zero).cast("int")
    placed = sets.select("doc_id", "n_lines", "line_no", "s", middle.alias("z"), F.sort_array(F.transform("s", ranked)).alias("r"))
    n, z = F.size("r"), F.col("z")
    parts = placed.select(
        "doc_id", "n_lines", "line_no", F.xxhash64("s").alias("h1"), F.slice("s", F.lit(1), z - 1).alias("low"), F.slice("s", z, F.greatest(n - z + 1, F.lit(0))).alias("high"),
        F.slice("s", F.lit(1), F.lit(HUBS)).alias("least"), F.slice("r", F.lit(1), _prefix_length(n, percent)).alias("front"),
    )
    return parts.select("doc_id", "n_lines", "line_no", "h1", (F.size("low") + F.size("high")).alias("n"), parity("low").alias("b1"), parity("high").alias("b2"), "least", F.col("front").alias("prefix"))


def _apart(line: str, other: str) -> Column:
    """In how many places the parities differ; columns named 1 and 2.

    Every word that only one of the lines has changes one place.
    """
    differ = [F.bit_count(F.col(f"{line}{i}").bitwiseXOR(F.col(f"{other}{i}"))) for i in (1, 2)]
    return differ[0] + differ[1]


def _alike(line: str, n: Column, other: str, m: Column, percent: int) -> Column:
    """Parity and length filter for lines of n and m words; the test that most pairs fail is first."""
    common = math.gcd(100 + percent, 100 - percent)
    places, words = (100 + percent) // common, (100 - percent) // common
    return (places * _apart(line, other) <= (n + m if words == 1 else words * (n + m))) & (100 * m >= percent * n) & (100 * n >= percent * m)


def _room(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Positional filter for sizes and places from 0."""
    return (100 + percent) * F.least(n - p, m - q) >= percent * (n + m)


def _same(*pairs: tuple[str, str]) -> Column:
    """A place in the texts is the same, null ids among them."""
    (d, e), (k, l) = pairs
    return F.col(d).eqNullSafe(F.col(e)) & (F.col(k) == F.col(l))


def _before(d: str, l: Column, doc_id: str, line_no: Column) -> Column:
    """A place is an earlier one; null ids come first."""
    d, doc_id = F.col(d), F.col(doc_id)
    return F.coalesce(d < doc_id, d.isNull() & doc_id.isNotNull()) | (d.eqNullSafe(doc_id) & (l < line_no))


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, line_no, s``: the distinct words of the lines of the ``pairs``, read from the texts."""
    ends = pairs.select("doc_id", "line_no").unionByName(pairs.select(F.col("d").alias("doc_id"), F.col("l").alias("line_no"))).distinct()
    ends = materialize(ends.withColumnsRenamed({"doc_id": "e", "line_no": "k"}), "line-ends")
    wanted = materialize(ends.groupBy(F.col("e").alias("w")).agg(F.count("*").alias("c")), "line-documents")
    with _bloom_filters(docs.sparkSession):
        texts = docs.select("doc_id", "text").join(checked_broadcast(wanted.where("c > 0").select("w")), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
        sets = _lines(texts).join(ends, _same(("doc_id", "e"), ("line_no", "k")), "left_semi").select("doc_id", "line_no", _word_set(F.col("line")).alias("s"))
        sets = materialize(sets, "line-sets")
    drop(ends, wanted)
    return sets


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines ``(doc_id, line_no)`` of the ``pairs`` that are similar enough; ``sets`` has all their lines."""
    x = sets.toDF("xd", "xl", "x")
    y = sets.toDF("yd", "yl", "y")
    shared = F.size(F.array_intersect("x", "y"))
    linked = (100 * shared) >= percent * (F.size("x") + F.size("y") - shared)
    both = pairs.join(x, _same(("doc_id", "xd"), ("line_no", "xl"))).join(y, _same(("d", "yd"), ("l", "yl")))
    return materialize(both.where(linked).select("doc_id", "line_no").distinct(), "similar-lines")


def repeated_lines(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """``doc_id, line_no`` of every line that has an earlier similar one."""
    return _repeated_lines(docs, percent, min_words)[0].distinct()


def _repeated_lines(docs: DataFrame, percent: int, min_words: int, counted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Lines that have an earlier similar one; if ``counted``, also ``doc_id, n_lines`` of every row that has a text."""
    spark = docs.sparkSession
    # read twice and then let go; what a lost executor held of it is made again from the texts
    sets = _line_sets(docs.where("text is not null")).persist(StorageLevel.DISK_ONLY)
    lines = materialize(_prefixes(sets, percent), "lines", hashes=("h1", "b1", "b2", "least", "prefix"))
    sets.unpersist(True)
    counts = materialize(lines.where("line_no = 0").select("doc_id", "n_lines"), "line-counts") if counted else None
    taking_part = lines.where(F.col("n") >= max(min_words, 1))
    at = F.struct("doc_id", "line_no")
    # equal sets: a hash of 64 bits, the size and the 128 bits of parity
    same_set = ["h1", "n", "b1", "b2"]
    # most classes are of one line, which is no copy
    firsts = taking_part.groupBy(*same_set).agg(F.min(at).alias("first"), F.count("*").alias("c"))
    firsts = materialize(firsts.where("c > 1").drop("c"), "line-classes")
    placed = taking_part.join(firsts.hint("merge"), same_set, "left").withColumn("copy", F.coalesce(F.col("first") < at, F.lit(False)))
    kept = lambda c: F.when(~F.col("copy"), F.col(c)).alias(c)
    placed = materialize(placed.select("doc_id", "line_no", "n", "b1", "b2", "copy", kept("least"), kept("prefix")), "line-prefixes", hashes=("b1", "b2", "least", "prefix"))
    drop(lines, firsts)
    release_shuffles(spark)
    copies = placed.where("copy").select("doc_id", "line_no")
    # no set but an equal one is similar to a set that one word more would make unlike
    own = placed.where(~F.col("copy") & (100 * F.col("n") >= percent * (F.col("n") + 1)))
    pair = ["doc_id", "line_no", "d", "l"]

    members = own.select("doc_id", "line_no", "n", "b1", "b2", F.explode("least").alias("key"))
    other = {"doc_id": "d", "line_no": "l", "n": "m", "b1": "c1", "b2": "c2"}
    hubs = members.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("n").alias("m"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))).alias("e"), F.count("*").alias("c"))
    hubs = materialize(hubs.where("c > 1").select("key", "e.*"), "line-hubs")
    with_hub = members.join(hubs, "key").where(_alike("b", F.col("n"), "c", F.col("m"), percent) & _before("d", F.col("l"), "doc_id", F.col("line_no")))
    hub_pairs = materialize(with_hub.select(*pair).distinct(), "hub-pairs")
    drop(hubs)
    release_shuffles(spark)
    ends = _sets_of(docs, hub_pairs)
    near = _similar(hub_pairs, ends, percent)
    drop(hub_pairs, ends)
    release_shuffles(spark)

    decided = checked_broadcast(near.select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.lit(0).alias("decided")))
    marked = own.drop("copy", "least").join(decided, _same(("doc_id", "d"), ("line_no", "l")), "left").drop("d", "l")
    postings = _postings(marked, percent)
    # both sides get new names, or they would not count as the same exchange
    later, earlier = postings.toDF("id", "own", "x1", "x2", "place"), postings.toDF("d", "other", "c1", "c2", "seat")
    n, m, l, line_no = _low("own"), _low("other"), _high("other"), _high("own")
    p, q = (F.shiftright(F.col(c).bitwiseAND(F.lit(0x3FF)).cast("int"), 2) for c in ("place", "seat"))
    key = lambda c: F.shiftright(c, 64 - KEY_BITS)
    # the later line must be open, which is asked with the other line so that both sides stay the same rows, shuffled once
    is_open = F.col("place").bitwiseAND(F.lit(1)) + q > q
    one_at_home = F.col("place").bitwiseAND(F.col("seat")).bitwiseAND(F.lit(2)) == 0
    matched = _alike("x", n, "c", m, percent) & _room(n, p, m, q, percent) & one_at_home & is_open & _before("d", l, "id", line_no)
    pairs = later.join(earlier, key("place") == key("seat")).where(matched)
    pairs = materialize(pairs.select(F.col("id").alias("doc_id"), line_no.alias("line_no"), "d", l.alias("l"), _apart("x", "c").alias("apart")).distinct(), "line-pairs")
    release_shuffles(spark)
    best = pairs.groupBy("doc_id", "line_no").agg(F.min(F.struct("apart", "d", "l")).alias("e")).select("doc_id", "line_no", "e.d", "e.l")
    best = materialize(best, "closest-pairs")
    # the texts are read once for all pairs
    ends = _sets_of(docs, pairs)
    closest = _similar(best, ends, percent)
    done = closest.toDF("xd", "xl")
    tried = best.toDF("yd", "yl", "yd2", "yl2")
    rest = pairs.join(done, _same(("doc_id", "xd"), ("line_no", "xl")), "left_anti")
    rest = materialize(rest.join(tried, _same(("doc_id", "yd"), ("line_no", "yl")) & _same(("d", "yd2"), ("l", "yl2")), "left_anti").select(*pair), "rest-pairs")
    last = _similar(rest, ends, percent)
    drop(pairs, best, rest, ends)
    return copies.unionByName(near).unionByName(closest).unionByName(last), counts


def _postings(lines: DataFrame, percent: int) -> DataFrame:
    """``doc_id, line, b1, b2, place`` for the words of the lines' prefixes.

    A word's key also holds a band of sizes, each twice as large as the one before.  A line is at home
    in its own band and visits those above that may hold a larger similar line, where the
    shorter prefix of the smaller one of two lines is enough.  So a frequent word is split into
    bands, and few pairs of unlike size meet.

    Few wide columns make short rows: ``line`` is line number and size, ``place`` a key of 54 bits, the word's place (255 for
    any later one, which lets more pairs pass and loses none), whether the line is visiting and whether it is still open.
    """
    n = F.col("n")
    band = lambda size: F.floor(F.log2(size)).cast("int")
    larger = F.floor(F.lit(100) * n.cast("long") / F.lit(float(percent)))
    own = lines.select(
        "doc_id", "b1", "b2", _packed("line_no", n).alias("line"), F.coalesce("decided", F.lit(1)).alias("open"), "prefix", band(n).alias("home"),
        (n - F.ceil(2 * percent * n / F.lit(100.0 + percent)).cast("int") + 1).alias("short"), F.explode(F.sequence(band(n), F.greatest(band(larger), band(n)))).alias("band"),
    )
    away = F.col("band") > F.col("home")
    words = F.when(away, F.slice("prefix", F.lit(1), F.col("short"))).otherwise(F.col("prefix"))
    each = own.select("doc_id", "b1", "b2", "line", "band", F.when(away, F.lit(2)).otherwise(F.lit(0)).bitwiseOR(F.col("open")).alias("state"), F.posexplode(words).alias("p", "word"))
    rest = F.shiftleft(F.least("p", F.lit(255)), 2).bitwiseOR(F.col("state"))
    return each.select("doc_id", "line", "b1", "b2", _posting_key(F.col("word"), F.col("band")).bitwiseOR(rest.cast("long")).alias("place"))


def _posting_key(word: Column, band: Column) -> Column:
    """The key of a word within a band of sizes, in the upper bits of a long."""
    return F.xxhash64(word, band).bitwiseAND(F.lit(-1 << (64 - KEY_BITS)))


def _packed(high: str, low: Column) -> Column:
    """Two ints as one long."""
    return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _high(packed: str) -> Column:
    return F.shiftrightunsigned(packed, 32).cast("int")


def _low(packed: str) -> Column:
    """As a long, from 0 on."""
    return F.col(packed).bitwiseAND(F.lit(0xFFFFFFFF))


def _gone(docs: DataFrame, percent: int, min_words: int, counted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``__id, removed``: line numbers, ascending, of documents that lose lines; the counts as in :func:`_repeated_lines`."""
    gone, counts = _repeated_lines(docs, percent, min_words, counted)
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    gone = materialize(gone, "removed-lines")
    release_shuffles(docs.sparkSession)
    return gone, counts


def _cleaned(docs: DataFrame, percent: int, min_words: int, keep: tuple[str, ...]) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``text``, ``n_lines``, ``removed`` (line numbers, ascending)."""
    # the texts are shuffled at every size, so that small inputs tell what large ones take
    gone = _gone(docs, percent, min_words)[0].hint("merge")
    none = F.array().cast("array<int>")
    source = docs.select("doc_id", "text", F.struct(*keep).alias("row"))
    joined = source.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("removed", F.coalesce("removed", none))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))
    return joined.select("row", text.alias("text"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), "removed")


def report(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """Per document: the number of its lines, of those removed, and their line numbers."""
    gone, counts = _gone(docs, percent, min_words, counted=True)
    gone = checked_broadcast(gone, 1 + F.size("removed"))
    # counted when the texts were split; only rows without a text are missing
    own = counts.unionByName(docs.where("text is null").select("doc_id", F.lit(0).alias("n_lines"))).withColumn("n_lines", F.col("n_lines").cast("long"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def remove_later(docs: DataFrame, percent: int = 80, min_words: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that is left and its ``n_chars``.

    A document that loses lines and has nothing but blanks left is dropped.
    """
    text = F.col("text")
    # the text travels beside the other columns, once
    rest = tuple(c for c in docs.columns if c != "text")
    cleaned = _cleaned(docs, percent, min_words, rest).where((F.size("removed") == 0) | text.rlike(r"[^ \n]"))
    chars = {c: F.when(F.size("removed") > 0, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return cleaned.select(*[text.alias(c) if c == "text" else chars.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
