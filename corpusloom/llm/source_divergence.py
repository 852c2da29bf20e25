"""How the sources of a language differ in their words: DuckDB over hash shards.

Tasks count terms per language and source as they read, so a frequent term or a large source
leaves a task as one row.  These counts are dealt into shards by a hash of language and term, where DuckDB
sums them and keeps the terms that enough documents of the language have.  With the totals of
all shards known, a second pass over the shards, in DuckDB again, gives partial sums
for pairs of sources and the best terms of each source; Spark adds the sums up and ranks.

All arithmetic is on integers.  In a group of ``n`` occurrences of kept terms (V of them in the language)
a term that occurs ``c`` times has ``p = 1 + floor(10^9 (c + 2) / (n + 2 V))``, and two
shares differ by ``f(p, q) = floor((p - q)^2 / (p + q))``.  A pair's value sums
``f`` over all kept terms; most terms are in few sources, so with ``z`` the share of
a term that isn't there the sum is taken apart::

    V f(z_a, z_b)  +  sum over terms of a:  f(p_a, z_b) - f(z_a, z_b)  +  the same for b
                   +  sum over terms of both:  f(p_a, p_b) - f(p_a, z_b) - f(z_a, p_b) + f(z_a, z_b)

The middle needs a group's distinct shares only, the last part the terms that both have.

Defined results: null texts, languages and sources count as ''.  A document is a row, also if ids repeat.
Every occurring group has its pairs; without kept terms their value is 0.  A language of one source has no pairs.
Empty tables give empty results.  Long texts are counted piece by piece, whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import checked_broadcast, drop, materialize, release_shuffles

#: Rows of counts in a shard.
SHARD_ROWS = 1_000_000
#: Counts that a task remembers before it hands them on.
HELD_COUNTS = 400_000
PIECE = 1 << 20
#: Parts that the groups of one language are dealt into.
SALTS = 32
#: Only A-Z are lowered; letters and all beyond ASCII make terms, the rest are gaps.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of batches of (text, lang, source); the term '' marks that a group occurs."""
    occurrences: dict[tuple[bytes, bytes], Counter[bytes]] = {}
    documents: dict[tuple[bytes, bytes], Counter[bytes]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            counts[b""] = 0
            terms = list(counts)
            columns = [pa.array([x] * len(terms), pa.binary()).cast(pa.string()) for x in (lang, source)]
            columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array(map(documents[lang, source].__getitem__, terms), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        held = sum(map(len, occurrences.values()))
        for text, *group in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            key = tuple(group)
            counts, docs = occurrences.setdefault(key, Counter()), documents.setdefault(key, Counter())
            before, seen = len(counts), set()
            for terms in _pieces(text):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(counts) - before
            if held > HELD_COUNTS:
                yield from handed_on()
                held = 0
    yield from handed_on()


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a long one in pieces that end at gaps."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _sql_in_shards(rows: DataFrame, shards: int, sql: str, schema: str) -> DataFrame:
    """``sql`` over ``part``, the rows of each shard by language and term, in DuckDB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        full = [b for b in batches if b.num_rows]
        if full:
            with duckdb.connect(config={"threads": 1}) as shard:
                shard.register("part", pa.Table.from_batches(full))
                shard.execute(_DIFFERENCE)
                yield from shard.sql(sql).to_arrow_reader(50_000)

    return rows.repartition(shards, "lang", "term").mapInArrow(run, schema)


#: The kept terms' counts, each with that of the language; one row of a term leads.  The marks of groups stay.
_KEPT = """
WITH counted AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM part GROUP BY ALL)
SELECT lang, source, term, n, CAST(sum(n) OVER term AS BIGINT) AS lang_n, CAST(row_number() OVER (term ORDER BY source) = 1 AND term <> '' AS BIGINT) AS lead
FROM counted WINDOW term AS (PARTITION BY lang, term) QUALIFY term = '' OR sum(docs) OVER term >= {least}
"""

#: How far two shares differ.
_DIFFERENCE = "CREATE OR REPLACE TEMP MACRO f(p, q) AS (p - q) * (p - q) // (p + q);"
_PARTIAL = """
WITH share AS (
    SELECT lang, source, term, CAST(1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q, z FROM part),
best AS (
    SELECT lang, source, term, f(p, q) AS value FROM share WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top})
SELECT 'both' AS part, a.lang, a.source, b.source AS item, 0::BIGINT AS p, CAST(sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z)) AS BIGINT) AS value
FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'own', lang, source, '', p, count(*) FROM share GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, 0, value FROM best
"""


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` ranks the other sources of the language by how much their words differ; part ``term`` has the ``top`` terms that
    the source uses more than its language.
    """
    spark = docs.sparkSession
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counts = materialize(docs.select(*text).mapInArrow(term_counts, "lang string, source string, term string, n long, docs long"), "term-counts")
    shards = max(math.ceil(counts.count() / SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = materialize(_sql_in_shards(counts, shards, _KEPT.format(least=least_docs), "lang string, source string, term string, n long, lang_n long, lead long"), "kept-terms")
    drop(counts)
    release_shuffles(spark)

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("leads"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("v"))
    groups = materialize(totals.drop("leads").join(checked_broadcast(langs), "lang").withColumn("z", F.expr("CASE WHEN v > 0 THEN 1 + 2000000000 div (total + 2 * v) END")), "term-groups")
    shares = kept.where("term <> ''").drop("lead").join(checked_broadcast(groups), ["lang", "source"])
    partial = _sql_in_shards(shares, shards, _PARTIAL.format(top=top), "part string, lang string, source string, item string, p long, value long")
    partial = materialize(partial, "divergence-parts")
    drop(kept)
    release_shuffles(spark)

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_value))
    terms = ranked(partial.where("part = 'term'").select("lang", "source", "item", "value")).where(F.col("rank") <= top)
    shape = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(ranked(_pair_values(groups, partial)), "pair").unionByName(shape(terms, "term"))


def _pair_values(groups: DataFrame, partial: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources; a language's groups are dealt out by salt."""
    salted: Callable[..., Column] = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).alias("salt")
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    own = groups.select("lang", "source", "v", "z", salted("source"))
    base = own.join(others, ["lang", "salt"]).where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * _difference("z", "y"), F.lit(0)).alias("value"))
    shares = partial.where("part = 'own'").groupBy("lang", "source", "p").agg(F.sum("value").alias("m")).join(checked_broadcast(groups.select("lang", "source", "z")), ["lang", "source"])
    alone = shares.withColumn("salt", salted("source", "p")).join(others, ["lang", "salt"]).where("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("m") * (_difference("p", "y") - _difference("z", "y"))).alias("value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = partial.where("part = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda rows: rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = [alone, turned(alone), both, turned(both)]
    for part in parts:
        base = base.unionByName(part)
    return base.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
