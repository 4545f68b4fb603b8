"""Exact deduplication against a persistent digest index.

The index is an external table of the SHA-256 digests of all texts admitted so far, bucketed and sorted by digest. A
batch is first reduced to one row per digest, then sort-merge anti-joined with the index, which is read without a
shuffle; what is left is written, and its digests are appended. The batch's rows are written before the index grows, in a
folder that gets the batch's name when it is complete and is never overwritten: ingesting a named batch again, after
success or after a job that died at any point, gives its stored rows and appends what the index lacks of them.

Cases: a null text counts as an empty one; of rows with equal texts the one with the least id stays (a null id last,
then by the hash of the other columns; of fully equal rows any one); an empty batch admits nothing; the result has the
batch's columns, whatever their names; very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import documents, fresh_path, inner, quoted, width

DIGEST, RANK = inner("digest"), inner("rank")


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A digest index at ``path``, made there if there is none; a later session opens it by the same path and buckets.
    Each compaction is a new generation of the table; the last complete one counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets or width(spark)
        self._open(max(self._generations(), default=0))

    def _files(self, path: str):
        """(the file system of a path, the path for it)."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _generations(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        fs, root = self._files(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [int(n.split("-")[1]) for n in names if n.startswith("digests-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _open(self, generation: int) -> None:
        self.generation, self.at = generation, f"{self.path}/digests-{generation:06d}"
        self.name = "kabunoki_digests_" + hashlib.sha256(self.at.encode()).hexdigest()[:16]
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, batch STRING) USING parquet LOCATION '{self.at}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _append(self, digests: DataFrame, name: str, at: str, mode: str) -> None:
        digests.repartition(self.buckets, "digest").write.mode(mode).bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", at).saveAsTable(name)

    def digests(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """The rows of ``docs`` whose text neither the index nor an earlier row has; their digests are appended. A batch
        of a name that was ingested before isn't looked at: its rows are those that were admitted then."""
        name = batch or fresh_path(self.spark, "b").rsplit("/", 1)[1]
        at = f"{self.path}/batches/{name}"
        fs, folder = self._files(at)
        stored = T.StructType([*docs.schema.fields, T.StructField(DIGEST, T.BinaryType())])
        seen = self.digests().select(F.col("digest").alias(DIGEST)).hint("merge")
        if fs.exists(folder):
            kept = self.spark.read.schema(stored).parquet(at)
            lacks = kept.join(seen, DIGEST, "left_anti")
        else:
            self._admit(docs, id_col, text_col, seen, at)
            kept = lacks = self.spark.read.schema(stored).parquet(at)
        self._append(lacks.select(F.col(DIGEST).alias("digest"), F.lit(name).alias("batch")), self.name, self.at, "append")
        return kept.drop(DIGEST)

    def _admit(self, docs: DataFrame, id_col: str, text_col: str, seen: DataFrame, at: str) -> None:
        rest = [F.col(quoted(c)).cast("string") for c in docs.columns if c not in (id_col, text_col)]
        first = W.partitionBy(DIGEST).orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(F.lit(0), *rest))
        one = docs.withColumn(DIGEST, digest(text_col)).withColumn(RANK, F.row_number().over(first)).where(F.col(RANK) == 1).drop(RANK)
        new = one.join(seen, DIGEST, "left_anti").select(*map(quoted, docs.columns), DIGEST)
        under_way = f"{self.path}/under-way/{uuid.uuid4().hex}"
        new.write.option("compression", "zstd").parquet(under_way)
        fs, folder = self._files(at)
        fs.mkdirs(folder.getParent())
        if not fs.rename(self._files(under_way)[1], folder):
            raise OSError(f"{under_way} can't be renamed to {at}")

    def compact(self) -> None:
        """Rewrite the index as one sorted file per bucket, after many appends."""
        new = self.generation + 1
        self._append(self.digests().dropDuplicates(["digest"]), self.name + "_next", f"{self.path}/digests-{new:06d}", "overwrite")
        self.spark.sql(f"DROP TABLE {self.name}_next")
        self.spark.sql(f"DROP TABLE {self.name}")
        self._open(new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark, fresh_path(spark, "digest-index")).ingest(documents(spark, sf_dir))


SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS rn FROM documents
) WHERE rn = 1
"""
