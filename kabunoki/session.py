"""Session settings that every plan assumes, and loaders that normalise what they read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()
_own: dict[str, str] = {}


def session(name: str = "kabunoki", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the number of shuffle partitions is the owner's to set."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.filterPushdown": "true",
        # Where each column was written isn't sent to the JVM: plans of a thousand expressions are built twice as fast.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def finite(c: F.Column) -> F.Column:
    """The number, or null where it is NaN or infinite: to Spark NaN is a value, to this engine it is missing."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)  # NaN is greater than infinity here


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with NaN normalised to null in its floating-point columns."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions, which a job's owner sets for the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def workspace(spark: SparkSession) -> str:
    """The folder of this application in the one that all executors share, spark.checkpoint.dir. Where that is unset a
    local one serves, which this process removes at its end, if all executors are on this machine; else it's an error."""
    app = spark.sparkContext.applicationId
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/kabunoki-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kabunoki-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here, so an executor that is lost later
    costs no recomputation, and what is not deterministic is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def stable(df: DataFrame, name: str) -> DataFrame:
    """The same rows in partitions that a repeated task reads in the same order: rows out of a shuffle are written."""
    plan = df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    return written(df, name) if "Exchange" in plan else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kabunoki-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/kabunoki.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, Path(package.name) / file.relative_to(package))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
