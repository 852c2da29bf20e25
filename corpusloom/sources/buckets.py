"""Stored tables in buckets by key, of which a merge rewrites only those that it touches.

A store's manifest names, for every bucketed table, the version that holds each bucket.  A batch writes the new
buckets of all its tables beside the old ones and then one manifest of the next version, and with that file all of
them change at once; whatever breaks off before it changes nothing.  The manifest also keeps the batch's mark, so a
batch that comes again is recognised and left out whole.  A store has one writer at a time.

Buckets that no manifest names any more are deleted when the next batch is done, so a reader that began with
the manifest before the last one can finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_MANIFESTS, _DATA = "_manifest", "_buckets"


class Merge(NamedTuple):
    """New rows of a table, the column that its buckets are by, and how old and new rows of some buckets become one table."""

    rows: DataFrame
    key: str
    combine: Callable[[DataFrame, DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def manifest(spark: SparkSession, store: str) -> dict:
    """The newest whole manifest; an empty one if there is none."""
    for version in sorted((int(n) for n in _names(spark, f"{store.rstrip('/')}/{_MANIFESTS}") if n.isdigit()), reverse=True):
        lines = spark.read.text(f"{store.rstrip('/')}/{_MANIFESTS}/{version}", wholetext=True).collect()
        try:
            return json.loads(lines[0][0])
        except (IndexError, ValueError):  # its writer broke off
            continue
    return {"version": 0, "mark": None, "tables": {}}


def _commit(spark: SparkSession, store: str, wanted: Mapping) -> None:
    fs, at = _files(spark, f"{store.rstrip('/')}/{_MANIFESTS}/{wanted['version']}")
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(wanted).encode()))
    finally:
        out.close()


def _path(store: str, name: str, version: int, bucket: int | str | None = None) -> str:
    return f"{store.rstrip('/')}/{_DATA}/{name}/{version}" + ("" if bucket is None else f"/bucket={bucket}")


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _read(spark: SparkSession, store: str, name: str, known: Mapping, buckets: set[int] | None = None) -> DataFrame:
    paths = [_path(store, name, version, b) for b, version in sorted(known["at"].items()) if buckets is None or int(b) in buckets]
    rows = spark.createDataFrame([], known["schema"])
    return spark.read.schema(known["schema"]).parquet(*paths) if paths else rows


def table(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The rows of a bucketed table, or nothing if the store has none of that name."""
    known = manifest(spark, store)["tables"].get(name)
    return None if known is None else _read(spark, store, name, known)


def tables(spark: SparkSession, store: str) -> set[str]:
    return set(manifest(spark, store)["tables"])


def forget(spark: SparkSession, store: str, name: str) -> None:
    """The table is no longer bucketed."""
    now = manifest(spark, store)
    if name in now["tables"]:
        kept = {k: v for k, v in now["tables"].items() if k != name}
        _commit(spark, store, {**now, "version": now["version"] + 1, "tables": kept})


def merge(spark: SparkSession, store: str, batch: Mapping[str, Merge], mark: str | None = None, start: Callable[[str], DataFrame | None] = lambda name: None, buckets: int = BUCKETS) -> dict[str, int]:
    """Merge a batch into its tables and return how many buckets of each were rewritten; nothing if ``mark`` is that of the last batch.

    A table that isn't bucketed yet begins with the rows that ``start`` gives for it.
    """
    before = manifest(spark, store)
    if mark is not None and before["mark"] == mark:
        return {}
    version, changed, written = before["version"] + 1, dict(before["tables"]), {}
    for name, (rows, key, combine) in batch.items():
        known = changed.get(name)
        n = known["buckets"] if known else buckets
        arrived = f"{_path(store, name, version)}-new"
        # the new rows are used twice: to tell the buckets and to fill them
        rows.withColumn("bucket", bucket_of(key, n)).write.mode("overwrite").parquet(arrived)
        new = spark.read.parquet(arrived)
        old = start(name) if known is None else None
        if known is None and old is not None:
            touched = set(range(n))
        else:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
            old = _read(spark, store, name, known, touched) if known else new.drop("bucket").limit(0)
        merged = combine(old, new.drop("bucket"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
        merged.withColumn("bucket", bucket_of(key, n)).repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_path(store, name, version))
        full = {x.removeprefix("bucket=") for x in _names(spark, _path(store, name, version)) if x.startswith("bucket=")}
        kept = {b: v for b, v in (known["at"] if known else {}).items() if int(b) not in touched}
        changed[name] = {"buckets": n, "schema": schema, "at": {**kept, **dict.fromkeys(sorted(full, key=int), version)}}
        written[name] = len(full)
    _commit(spark, store, {"version": version, "mark": mark, "tables": changed})
    _clean(spark, store, [before["tables"], changed])
    return written


def _clean(spark: SparkSession, store: str, used: list[Mapping]) -> None:
    """Delete the buckets and manifests that neither of the last two versions names."""
    named = {(name, str(v), b) for tables_ in used for name, t in tables_.items() for b, v in t["at"].items()}
    for name in _names(spark, f"{store.rstrip('/')}/{_DATA}"):
        for version in _names(spark, f"{store.rstrip('/')}/{_DATA}/{name}"):
            own = {b for n, v, b in named if (n, v) == (name, version)}
            there = [x for x in _names(spark, _path(store, name, version)) if x.startswith("bucket=")] if own else []
            gone = [_path(store, name, version)] if not own else [_path(store, name, version, b) for x in there if (b := x.removeprefix("bucket=")) not in own]
            for path in gone:
                fs, at = _files(spark, path)
                fs.delete(at, True)
    versions = sorted((int(n) for n in _names(spark, f"{store.rstrip('/')}/{_MANIFESTS}") if n.isdigit()), reverse=True)
    for old in versions[2:]:
        fs, at = _files(spark, f"{store.rstrip('/')}/{_MANIFESTS}/{old}")
        fs.delete(at, True)
