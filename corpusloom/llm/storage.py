"""Shared-folder tables that cut lineage and survive lost executors.

Intermediate results are written as Parquet below the folder named by
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and
never a recomputation of what came before.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only a local session without that
    setting (as in tests) falls back to a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Columns of ``hashes`` hardly repeat, so no dictionary is tried for them, and a table with such is compressed lightly.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    plain = {f"parquet.enable.dictionary#{c}.list.element" if c in arrays else f"parquet.enable.dictionary#{c}": "false" for c in hashes}
    df.write.options(compression="lz4_raw" if hashes else "zstd", **plain).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def checked_broadcast(table: DataFrame, weight: Column | None = None, most: int = 500_000) -> DataFrame:
    """``table``, marked for broadcast if its rows weigh at most ``most`` together.

    A row weighs 1 (a few numbers), or ``weight``.  The size is counted, and a larger
    table is joined by a shuffle as it would be otherwise.
    """
    total = table.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(table) if total <= most else table


def release_shuffles(spark: SparkSession) -> None:
    """Let the cleaner delete the shuffle files of finished writes now.

    It does so once their plans are garbage on the driver, which on an idle
    driver may take long while the executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once nothing reads them."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
