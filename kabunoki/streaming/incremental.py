"""Incremental ingestion: files that arrive are read once each and upserted by key into a versioned table.

The stream's checkpoint knows which files were read; each micro-batch writes a new version next to the last and swaps a
pointer, so a batch that is delivered twice gives the same table, and readers see whole versions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from kabunoki.operators.documents import first_per_key
from kabunoki.operators.operations import upsert
from kabunoki.operators.publication import read_text, remove, write_text


class VersionedTable:
    """Parquet versions under a path of any file system that Spark knows, and a pointer to the current one, swapped by a
    rename. Of the versions the last two stay: a reader may be at the one before."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[Column]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.pointer = f"{self.path}/latest.json"

    def version(self) -> dict | None:
        text = read_text(self.spark, self.pointer)
        return json.loads(text) if text else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(v["path"]) if v else None

    def apply(self, batch: DataFrame, number: int) -> None:
        now = self.version()
        if now and now["batch"] >= number:
            return
        old = self.read()
        new = first_per_key(batch, self.keys, *self.order) if old is None else upsert(old, batch, self.keys, self.order)
        to = f"{self.path}/v{number}"
        new.write.mode("overwrite").parquet(to)
        write_text(self.spark, self.pointer, json.dumps({"path": to, "batch": number, "before": now and now["path"]}))
        if now and now.get("before"):
            remove(self.spark, now["before"])


def ingest(spark: SparkSession, source: str, schema: StructType, table: VersionedTable, checkpoint: str, pattern: str | None = None, files_per_batch: int = 1) -> None:
    """Read all files that are there and not yet read, in batches, and stop."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    query = reader.parquet(source).writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
