"""What the operators share: the shared folder, written tables, and partitions chosen by number."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.session import fresh_path, ship, stable, width, workspace, written

__all__ = ["fresh_path", "ship", "stable", "width", "written"]

BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, *more: F.Column) -> DataFrame:
    """``df`` to be broadcast if its rows take no more than BROADCAST_BYTES, else as it is, for a join that shuffles.
    ``more``: how many numbers a row has besides its columns, in arrays."""
    row = sum((F.coalesce(m, F.lit(0)).cast("long") for m in more), F.lit(0)) * 8 + F.lit(16 + 8 * len(df.columns))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else df


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    files, path = _files(df.sparkSession, df._written)
    files.delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application wrote in the shared folder; for a job's owner, when its results are
    stored."""
    files, path = _files(spark, workspace(spark))
    files.delete(path, True)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files that no live plan refers to; without a collection of the driver's
    garbage it may keep them for half an hour."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def inner(name: str) -> str:
    """A column name that no caller's table has."""
    return f"__kabunoki_{name}"


def text_bytes(name: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers. Columns whose names have dots or ticks, by which it can't find
    them, go in under others; what comes out is named by the schema."""
    ship(df.sparkSession)
    safe = [inner(f"column_{k}") if set(c) & set(".`") else c for k, c in enumerate(df.columns)]

    def whole(batches):
        yield from run(batches)
        give_back()

    return (df.toDF(*safe) if safe != df.columns else df).mapInArrow(whole, schema)


def give_back() -> None:
    """Return what this worker has freed to the system: idle workers would keep it, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
