"""Readers of corpora, dictionaries, anchor lists and stored tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.lexicon import forms, frequency, level, unique_join
from corpusloom.functions.text import strip
from corpusloom.operators.statistics import with_share
from corpusloom.schemas import DICTIONARY_JSON, FLASH_CARDS, LEGACY_COLUMNS
from corpusloom.sources import buckets


#: What a table being replaced is called meanwhile, and the one it replaces.
NEXT, OLD = "__next", "__old"


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a CSV file with a header as ``value``: stripped, blanks dropped, repeats kept."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if column not in rows.columns:
        raise ValueError(f"no column {column!r} in {path}; it has {rows.columns}")
    return rows.select(strip(F.col(f"`{column}`")).alias("value")).where("value <> ''")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table that splits into fewer parts than there are cores, dealt out by ``key``.

    Such a table may hold no more than one row group per file, which one task reads, so whatever is computed from
    its texts would run in few tasks.  A table of more parts, be it of many files or of large ones, is left as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def flash_cards(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without a header; missing ones read as the text ``nan``, as exports are joined so."""
    return spark.read.csv(path, sep="\t", schema=FLASH_CARDS).na.fill("nan")


def lines(spark: SparkSession, path: str, limit: int | None = None, max_kept: int | None = None) -> DataFrame:
    """Stripped, non-blank lines as ``value`` with their ``line_no``.

    ``limit`` counts raw lines, blank ones too; ``max_kept`` counts kept ones.  A limit
    needs the order of the file and applies to a single file; without one no order is
    asked for and the scan stays splittable.
    """
    if limit is None and max_kept is None:
        rows = spark.read.text(path).select(strip(F.col("value")).alias("value"), F.monotonically_increasing_id().alias("line_no"))
        return rows.where("value <> ''")
    # rows come in the order of the file within a block, and the blocks' sizes tell where each begins
    within = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = sorted(map(tuple, within.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()))
    starts, seen = [], 0
    for block, first, n in blocks:
        starts.append((block, seen - first))
        seen += n
    # one row for each block of a file
    known = F.broadcast(spark.createDataFrame(starts, "block long, shift long"))
    rows = within.join(known, "block").select(strip(F.col("value")).alias("value"), (F.col("at") + F.col("shift")).alias("line_no"))
    kept = (rows.where(F.col("line_no") < limit) if limit is not None else rows).where("value <> ''")
    return kept.orderBy("line_no").limit(max_kept) if max_kept is not None else kept


def line_totals(spark: SparkSession, path: str) -> DataFrame:
    """``lines_seen`` and ``lines_kept`` of a text file."""
    value = strip(F.col("value"))
    return spark.read.text(path).agg(F.count("*").alias("lines_seen"), F.count_if(value != "").alias("lines_kept"))


def wiki_texts(spark: SparkSession, root: str, skip_rest: bool = True) -> DataFrame:
    """``id, text`` of JSON lines in a folder tree.

    A record that isn't an object, or has a text that isn't one, ends its file: what follows it there is left out
    too, or, without ``skip_rest``, nothing but the record.  A record that repeats a key counts as such a one.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    # rows come in the order of the file within a block
    doc = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.try_parse_json("value").alias("doc"))
    text = F.try_variant_get("doc", "$.text", "variant")
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT<"), F.lit(False))
    good = is_object & (text.isNull() | (F.schema_of_variant(text) == "STRING"))
    rows = doc.select("file", "at", good.alias("good"), F.try_variant_get("doc", "$.id", "string").alias("id"), F.coalesce(F.try_variant_get("doc", "$.text", "string"), F.lit("")).alias("text"))
    if skip_rest:
        ends = rows.where(~F.col("good")).groupBy("file").agg(F.min("at").alias("end"))
        rows = rows.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    return rows.where("good").select("id", "text")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array with parsed level, frequency and forms, and their ``ordinal``.

    The file is read as a stream of entries, so it may be longer than a text can be.  Anything but an array of objects is an error.
    """
    # what stands before the first bracket, and the beginning of what follows it
    parts = spark.read.text(path, lineSep="[").limit(2).collect()
    rows = spark.read.schema(f"{DICTIONARY_JSON}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True).cache()
    try:
        if len(parts) < 2 or parts[0][0].strip() or not rows.where("_bad IS NOT NULL").isEmpty():
            raise ValueError(f"{path} isn't a JSON array of entries")
    finally:
        rows.unpersist()
    # one file is one partition, whose rows are numbered in order
    each = rows.select(F.monotonically_increasing_id().cast("int").alias("ordinal"), F.struct(*[c for c in rows.columns if c != "_bad"]).alias("e"))
    own = forms(F.coalesce(F.col("e.forms"), F.array().cast(each.selectExpr("e.forms").schema[0].dataType)))
    simplified = strip(F.coalesce(F.col("e.simplified"), F.lit("")))
    return each.select(
        "ordinal", simplified.alias("simplified"), level(F.col("e.level")).alias("level"), frequency(F.col("e.frequency")).alias("frequency"),
        own["pinyin"].alias("pinyin"), own["meanings"].alias("meanings"), F.col("e.pos").alias("pos"), own["traditional"].alias("traditional"),
    ).where("simplified <> ''")


def lexicon_rows(entries: DataFrame) -> DataFrame:
    """Entries as rows of the lexicon table: parts of speech joined."""
    return entries.withColumn("pos", unique_join(F.col("pos"), ";")).drop("ordinal")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon table; columns that older ones lack are null."""
    rows = spark.read.parquet(path)
    optional = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("traditional", "pos")}
    return rows.select("simplified", "level", "frequency", "pinyin", "meanings", *optional.values())


def anchors(spark: SparkSession, path: str, allow_list: bool = True, required: bool = True) -> DataFrame:
    """``ordinal, token`` of a JSON object with ``anchors``, or (if allowed) of a plain JSON array."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    payload = json.loads(text)
    if isinstance(payload, dict):
        listed = payload.get("anchors")
    else:
        listed = payload if allow_list else None
    if not isinstance(listed, list):
        raise ValueError(f"{path} has no list of anchors")
    tokens = [str(x).strip() for x in listed if str(x).strip()]
    if required and not tokens:
        raise ValueError(f"{path} lists no anchors")
    return spark.createDataFrame(list(enumerate(tokens)), "ordinal long, token string")


def anchors_or_meta(spark: SparkSession, path: str | None, meta: DataFrame) -> DataFrame:
    """The file's anchors, or those that the store remembers."""
    if path is not None:
        return anchors(spark, path)
    kept = meta.where("key = 'anchors_json'").select(F.posexplode(json_array(F.col("value"))).alias("ordinal", "token"))
    return kept.select(F.col("ordinal").cast("long").alias("ordinal"), "token")


def json_array(text: Column, kind: str = "string") -> Column:
    """Elements of a JSON array in text; nothing if it is malformed."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def meta(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys and values of a store's small meta table; none if there is no such table."""
    settle(spark, path)
    if not exists(spark, path):
        return {}
    return {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def settle(spark: SparkSession, path: str) -> None:
    """Finish a replacement of the table at ``path`` that broke off: a complete new table takes its place, or else the old one is put back."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)) or not fs.exists(at(path + OLD)):
        return
    # the old table is moved away only when the new one is complete
    source = path + NEXT if fs.exists(at(f"{path}{NEXT}/_SUCCESS")) else path + OLD
    if not fs.rename(at(source), at(path)):
        raise OSError(f"can't move {source} to {path}")


def tables(spark: SparkSession, store: str) -> list[str]:
    """Names of the tables in a store's folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = {s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()}
    for name in names:
        if name.endswith(OLD):
            settle(spark, f"{store.rstrip('/')}/{name.removesuffix(OLD)}")
    return sorted(n for n in {x.removesuffix(OLD) for x in names} | buckets.tables(spark, store) if not n.endswith(NEXT) and not n.startswith("_"))


def first_table(spark: SparkSession, store: str, *names: str) -> str | None:
    """The first of ``names`` that the store has."""
    there = set(tables(spark, store))
    return next((n for n in names if n in there), None)


def table(spark: SparkSession, store: str, name: str, schema: str | None = None) -> DataFrame:
    """A stored table under current column names; empty if it is missing and ``schema`` is given."""
    bucketed = buckets.table(spark, store, name)
    if bucketed is not None:
        # shares aren't stored in buckets, as each changes with every merge
        return with_share(bucketed) if name == "pattern_global_stats" else bucketed
    path = f"{store.rstrip('/')}/{name}"
    settle(spark, path)
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(schema))
    rows = spark.read.parquet(path)
    for old, new in LEGACY_COLUMNS.items():
        if old in rows.columns and new not in rows.columns and "pattern" in name:
            rows = rows.withColumnRenamed(old, new)
    return rows
