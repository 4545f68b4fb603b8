"""Snapshots for readers: versioned partitions, runs of parquet tables behind an atomic pointer, and a model registry.

A run is written in full before the pointer to it is swapped, so a reader sees the old run or the new one. Paths may be
on any file system that Spark knows; the swap is a rename, which is atomic on local and HDFS-like ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.operators.documents import first_per_key
from kabunoki.operators.learning import Ridge, evaluate_ranking, infer
from kabunoki.sources.saved import write_csv


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there."""
    jvm, p, fs = _fs(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, jvm, temporary, p)


def _rename(spark: SparkSession, jvm, temporary, p) -> None:
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(context.makeQualified(temporary), context.makeQualified(p), options)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    _, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def replace_version(frame: DataFrame, path: str, version: str) -> None:
    """Delete and insert the rows of one version: the overwrite of its partition."""
    frame.select(*[c for c in frame.columns if c != version], version).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def publish(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], facts: dict | None = None) -> dict:
    """Write the tables of a run, then point readers to it. Returns the manifest, with the rows of each table."""
    if not run or any(c in run for c in "/\\") or run in (".", ".."):
        raise ValueError("a run is named by one path component")
    base = f"{root.rstrip('/')}/runs/{run}"
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}")
    counts = {name: spark.read.parquet(f"{base}/{name}").count() for name in tables}
    manifest = {"run": run, "rows": counts} | (facts or {})
    write_text(spark, f"{base}/manifest.json", json.dumps(manifest, default=str))
    write_text(spark, f"{root.rstrip('/')}/latest.json", json.dumps({"run": run}))
    return manifest


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the latest run."""
    pointer = read_text(spark, f"{root.rstrip('/')}/latest.json")
    if pointer is None:
        raise FileNotFoundError("nothing is published here")
    run = json.loads(pointer)["run"]
    if "/" in run or "/" in table or run == "..":
        raise ValueError("a pointer outside its folder")
    return spark.read.parquet(f"{root.rstrip('/')}/runs/{run}/{table}")


def model_inputs(ranks: DataFrame, securities: DataFrame, prices: DataFrame, fundamentals: DataFrame, qualitative: DataFrame, snapshot: str, version: str) -> DataFrame:
    """Everything known of each ranked security on a day: of each kind of feature the row calculated last."""
    on = F.col("snapshot_date") == F.lit(snapshot).cast("date")
    last = lambda f: first_per_key(f.where(on), ["canonical_code"], F.desc("calculated_at")).drop("snapshot_date", "calculated_at", "feature_version")
    r = ranks.where(on & (F.col("ranking_version") == version)).drop("price_date", "disclosure_date", "latest_price", "calculated_at", "feature_version")
    p = last(prices).withColumnsRenamed({"momentum_score": "price_momentum_score", "risk_score": "price_risk_score"})
    f, q = last(fundamentals), last(qualitative).withColumnRenamed("document_count", "qualitative_document_count")
    out = r.join(securities.select("canonical_code", "company_name", "sector33_name"), "canonical_code")
    for side in (p, f, q):
        out = out.join(side.select("canonical_code", *[c for c in side.columns if c not in out.columns]), "canonical_code", "left")
    return out.orderBy("rank_12m", "canonical_code")


def save_models(spark: SparkSession, root: str, run: str, models: dict[str, Ridge], report: dict, predictions: dict[str, DataFrame] | None = None) -> None:
    """Store the models of a run by horizon, with their predictions and a table of coefficients, then what they measured;
    a run counts once it has all of that."""
    base = f"{root.rstrip('/')}/{run}"
    for horizon, frame in (predictions or {}).items():
        frame.write.mode("overwrite").parquet(f"{base}/{horizon}/predictions")
    for horizon, m in models.items():
        rows = spark.createDataFrame(list(zip(m.features, m.coefficients)), "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))
        write_csv(rows, f"{base}/{horizon}/coefficients")
    write_text(spark, f"{base}/models.json", json.dumps({h: json.loads(m.dumps()) for h, m in models.items()}))
    write_text(spark, f"{base}/metrics.json", json.dumps(report, default=str))
    write_text(spark, f"{root.rstrip('/')}/latest.json", json.dumps({"run": run}))


def runs(spark: SparkSession, root: str) -> list[str]:
    """The folders of complete runs, by name."""
    jvm, p, fs = _fs(spark, root.rstrip("/"))
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}/metrics.json")))


def latest_run(spark: SparkSession, root: str, horizons: Iterable[str]) -> str:
    """The last complete run, by name, that has models for all the horizons."""
    for run in reversed(runs(spark, root)):
        if set(horizons) <= set(json.loads(read_text(spark, f"{root.rstrip('/')}/{run}/models.json") or "{}")):
            return run
    raise FileNotFoundError("no run has models for all horizons")


def load_models(spark: SparkSession, root: str, horizons: Iterable[str], run: str | None = None) -> dict[str, Ridge]:
    """The models of a run, or of the one that was stored last, which must have all the horizons."""
    if run is None:
        pointer = read_text(spark, f"{root.rstrip('/')}/latest.json")
        if pointer is None:
            raise FileNotFoundError("no model is registered here")
        run = json.loads(pointer)["run"]
    found = json.loads(read_text(spark, f"{root.rstrip('/')}/{run}/models.json") or "{}")
    return {h: Ridge(**found[h]) for h in horizons}


def evaluate_model(spark: SparkSession, root: str, horizon: str, run: str | None = None) -> DataFrame:
    """Two rows, of the model and of the rule it is compared with (``scored_by``): measures over a stored run's test months;
    of the last run with that horizon, if none is named."""
    run = run or latest_run(spark, root, [horizon])
    test = spark.read.parquet(f"{root.rstrip('/')}/{run}/{horizon}/predictions").where("split = 'test'")
    rows = [evaluate_ranking(test, c, "actual_return").select(F.lit(name).alias("scored_by"), "*") for name, c in (("model", "prediction"), ("rule", "baseline_score"))]
    return rows[0].unionByName(rows[1]).withColumns({"model_run": F.lit(run), "horizon": F.lit(horizon)})


def infer_latest(spark: SparkSession, published_root: str, model_root: str, table: str = "model_input_latest", horizons: Iterable[str] = ("6m", "12m")) -> dict[str, DataFrame]:
    """Scores and ranks of the latest published rows by the last complete run's models, by horizon."""
    horizons = list(horizons)
    inputs = published(spark, published_root, table)
    if inputs.isEmpty():
        raise ValueError("the published inputs are empty")
    run = latest_run(spark, model_root, horizons)
    models = load_models(spark, model_root, horizons, run)
    identity = "canonical_code company_name sector33_name snapshot_date price_date disclosure_date latest_close per pbr roe confidence".split()
    out = {}
    for h in horizons:
        found = infer(inputs, models[h], h, run=run).withColumnRenamed(f"rank_{h}", "rule_rank")
        out[h] = found.select(*[c for c in identity if c in found.columns], *(["rule_rank"] if "rule_rank" in found.columns else []), "model_score", "model_rank", "horizon", "model_version", "model_run")
    return out


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A copy that appears under its name when it is whole."""
    jvm, p, fs = _fs(spark, source)
    _, to, there = _fs(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    temporary = jvm.org.apache.hadoop.fs.Path(target + ".tmp")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, there, temporary, False, True, conf)
    _rename(spark, jvm, temporary, to)


def backup(spark: SparkSession, table: str, target: str, created_at: str) -> dict:
    """Copy a table's files, and store their number, bytes and a SHA-256 of those of all files, by name, beside them."""
    jvm, p, fs = _fs(spark, table)
    if not fs.exists(p):
        raise FileNotFoundError(table)
    _, to, there = _fs(spark, target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, there, to, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    # A hash per file is made where the file is read; the driver hashes the list of them.
    every = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("hash")).orderBy("name").collect()
    facts = {"path": target, "created_at": created_at, "files": len(every), "size_bytes": sum(r["length"] for r in every), "sha256": hashlib.sha256("\n".join(f"{r['name']} {r['hash']}" for r in every).encode()).hexdigest()}
    write_text(spark, target.rstrip("/") + ".json", json.dumps(facts))
    return facts


def raw_manifest(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """``known`` with a row for each new content (content, source, retrieved_at), by its SHA-256; content that is there
    already adds nothing."""
    new = incoming.select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "source", "retrieved_at")
    new = first_per_key(new, ["content_hash"], F.col("retrieved_at"))
    return known.unionByName(new.join(known.select("content_hash"), "content_hash", "left_anti"))
