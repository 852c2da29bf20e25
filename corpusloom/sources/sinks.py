"""Writers: stored tables with replace, insert and merge modes; text, CSV and JSON files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.keys import family_of
from corpusloom.operators.statistics import merge_counts, replace_rows
from corpusloom.schemas import PRIOR_SCHEMA_VERSION, PRIOR_TABLES, SCHEMA_VERSION, STATE_TABLES
from corpusloom.sources import buckets
from corpusloom.sources.readers import NEXT, OLD, exists, settle, table


def _path(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def replace(rows: DataFrame, store: str, name: str, mark: str | None = None) -> None:
    """Write the table anew; ``rows`` may be computed from what it replaces.

    The new table is written beside the old one, which is moved away, not deleted, before the new one takes its
    place.  Whatever step fails, a whole table is left, and :func:`corpusloom.sources.readers.settle` puts it in place.  ``mark``
    names an empty file that comes with the table, in the same move.
    """
    spark, path = rows.sparkSession, _path(store, name)
    settle(spark, path)
    rows.write.mode("overwrite").parquet(path + NEXT)
    fs, at = _files(spark, path)
    if mark is not None:
        fs.create(at(f"{path}{NEXT}/{_mark(mark)}"), True).close()
    fs.delete(at(path + OLD), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(path + OLD)):
        raise OSError(f"can't move {path} away")
    if not fs.rename(at(path + NEXT), at(path)):
        raise OSError(f"can't move {path}{NEXT} to {path}")
    fs.delete(at(path + OLD), True)
    buckets.forget(spark, store, name)


def _mark(mark: str) -> str:
    return f"_mark-{mark}"


def marked(spark: SparkSession, store: str, name: str, mark: str) -> bool:
    """Whether the table was last replaced with that ``mark``."""
    settle(spark, _path(store, name))
    fs, at = _files(spark, store)
    return fs.exists(at(f"{_path(store, name)}/{_mark(mark)}"))


def create_store(spark: SparkSession, store: str, tables: Mapping[str, str], version_key: str, version: int) -> None:
    """Make missing tables, empty, and stamp the schema's version."""
    there = buckets.tables(spark, store)
    for name, schema in tables.items():
        if name not in there and not exists(spark, _path(store, name)):
            spark.createDataFrame([], StructType.fromDDL(schema)).write.parquet(_path(store, name))
    put_meta(spark, store, {version_key: version})


def create_state(spark: SparkSession, store: str) -> None:
    create_store(spark, store, STATE_TABLES, "schema_version", SCHEMA_VERSION)


def create_prior(spark: SparkSession, store: str) -> None:
    create_store(spark, store, PRIOR_TABLES, "prior_schema_version", PRIOR_SCHEMA_VERSION)


def put_meta(spark: SparkSession, store: str, values: Mapping[str, object]) -> None:
    """Insert or replace keys of the meta table."""
    new = spark.createDataFrame([(str(k), str(v)) for k, v in values.items()], "key string, value string")
    replace(replace_rows(table(spark, store, "meta"), new, "key") if exists(spark, _path(store, "meta")) else new, store, "meta")


def upsert(rows: DataFrame, store: str, name: str, key: str) -> None:
    """Insert rows and replace those with the same key; they are computed once."""
    spark = rows.sparkSession
    if exists(spark, _path(store, name)):
        old = table(spark, store, name)
        if old.isEmpty():
            rows = old.where(F.lit(False)).select(*rows.columns).unionByName(rows)
        else:
            path = scratch(spark, "upserted")
            rows.write.parquet(path, compression="zstd")
            rows = replace_rows(old, spark.read.parquet(path), key)
    replace(rows, store, name)


def insert_new(rows: DataFrame, store: str, name: str, by: Sequence[str]) -> None:
    """Append the rows whose ``by`` columns the table lacks; of several such rows one."""
    append(missing(rows.dropDuplicates(list(by)), store, name, by), store, name)


def missing(rows: DataFrame, store: str, name: str, by: Sequence[str]) -> DataFrame:
    """The rows whose ``by`` columns the table lacks."""
    spark = rows.sparkSession
    if not exists(spark, _path(store, name)):
        return rows
    there = table(spark, store, name).select(*by)
    return rows if there.isEmpty() else rows.join(there, list(by), "left_anti").select(*rows.columns)


def merge_prior(stats: DataFrame, realizations: DataFrame, store: str, cap: int, mark: str | None = None) -> dict[str, int]:
    """Add a batch's counts and realizations to the stored ones, both at once; the number of buckets rewritten of each table.

    Diversities keep the larger value, realizations those stored before and then new ones in order of their text, up to ``cap`` of a key (0: all).
    Shares change with every count, so they aren't stored but taken when the table is read.
    """
    spark = stats.sparkSession
    columns = ["pattern_key", "realization"]

    def counts(old: DataFrame, new: DataFrame) -> DataFrame:
        return merge_counts(old, new).withColumn("family", family_of(F.col("pattern_key")))

    def texts(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select(*columns).withColumn("late", F.lit(0)).unionByName(new.select(*columns).withColumn("late", F.lit(1)))
        each = both.groupBy(*columns).agg(F.min("late").alias("late"))
        if cap > 0:
            order = Window.partitionBy("pattern_key").orderBy("late", "realization")
            each = each.withColumn("n", F.row_number().over(order)).where((F.col("n") <= cap) | (F.col("late") == 0))
        return each.select(*columns)

    batch = {"pattern_global_stats": buckets.Merge(stats.drop("p_global"), "pattern_key", counts), "pattern_global_realizations": buckets.Merge(realizations, "pattern_key", texts)}
    plain = {name: table(spark, store, name) for name in batch if name not in buckets.tables(spark, store) and exists(spark, _path(store, name))}
    # an empty table has nothing to put into buckets
    start = {name: None if rows.isEmpty() else rows for name, rows in plain.items()}
    written = buckets.merge(spark, store, batch, mark, start.get)
    for name in plain:
        fs, at = _files(spark, _path(store, name))
        fs.delete(at(_path(store, name)), True)
    return written


def append(rows: DataFrame, store: str, name: str) -> None:
    rows.write.mode("append").parquet(_path(store, name), compression="zstd")


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    rows.select(column).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def anchors_json(anchors: Sequence[str], meta: Mapping[str, object] | None = None, stats: Mapping[str, object] | None = None) -> str:
    """The text of an anchor file."""
    payload: dict[str, object] = {"anchors": list(anchors)}
    if meta is not None:
        payload["meta"] = dict(meta)
    if stats is not None:
        payload["stats"] = dict(stats)
    return json.dumps(payload, ensure_ascii=False, indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, wherever Spark can write."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
