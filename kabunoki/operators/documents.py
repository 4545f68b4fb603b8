"""Disclosure documents: titles, codes, evidence checks and qualitative features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.functions.kit import collapse, squeeze

QUALITATIVE_VERSION = "qualitative_1"
#: By importance: of one day's documents the last of these speaks for the company.
PRIORITY = {"earnings_release": 4, "earnings_presentation": 3, "forecast_revision": 2, "dividend_revision": 1}
WEIGHTS = {"outlook_score": 0.30, "demand_score": 0.20, "profitability_score": 0.20, "risk_control_score": 0.15, "earnings_quality_score": 0.15}
FACTORS = 5


def title_class(title: Column) -> Column:
    """The type of a disclosure by its title; the order of the tests decides. A null title is of another type."""
    t = collapse(F.coalesce(title, F.lit("")))
    has = lambda pattern: F.rlike(t, F.lit(pattern))
    tests = {
        "earnings_release": has("決算短信|決算〔"),
        "earnings_presentation": has("決算(?:説明|補足|概要|ハイライト)"),
        "forecast_revision": has("業績予想") & has("修正|差異|変更"),
        "dividend_revision": has("配当予想") & has("修正|変更"),
        "earnings_schedule": has("決算発表(?:日|予定|時刻)"),
    }
    out = F.lit("other")
    for name, holds in reversed(tests.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def missing_analyses(documents: DataFrame, analyses: DataFrame, model: str, prompt: str, limit: int | None = None) -> DataFrame:
    """Documents that this model and prompt haven't analysed, oldest first, by importance within a day."""
    done = analyses.where((F.col("model") == model) & (F.col("prompt_version") == prompt)).select("document_id")
    place = F.lit(5)
    for name, p in PRIORITY.items():
        place = F.when(F.col("document_type") == name, 5 - p).otherwise(place)
    out = documents.where(F.col("document_type").isin(*PRIORITY)).join(done, "document_id", "left_anti").orderBy("disclosure_date", place, "document_id")
    return out.limit(limit) if limit else out


def check_evidence(analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """Analyses (with ``evidence``, an array of structs factor, excerpt) reduced to excerpts that stand in the document,
    white space aside; confidence is 0.8 times the share that do, times the share of the five factors they cover."""
    text = documents.select("document_id", squeeze(F.coalesce("text_content", F.lit(""))).alias("_text"))
    valid = F.filter("evidence", lambda e: F.contains(F.col("_text"), squeeze(e["excerpt"])))
    out = analyses.join(text, "document_id").withColumn("_n", F.size(F.coalesce("evidence", F.array().cast(analyses.schema["evidence"].dataType)))).withColumn("evidence", valid)
    covered = F.size(F.array_distinct(F.transform("evidence", lambda e: e["factor"]))) / float(FACTORS)
    share = F.when(F.col("_n") > 0, F.size("evidence") / F.col("_n")).otherwise(0.0)
    return out.withColumns({"confidence": F.lit(0.8) * share * F.coalesce(covered, F.lit(0.0)), "rejected": (F.col("_n") - F.coalesce(F.size("evidence"), F.lit(0))).cast("long")}).drop("_text", "_n")


EVIDENCE = "array<struct<factor:string,excerpt:string>>"
REVIEW = "human_summary_ok human_scores_ok human_evidence_ok review_notes".split()


def evaluation_rows(analyses: DataFrame, documents: DataFrame, securities: DataFrame, model: str, prompt: str) -> DataFrame:
    """A row for each analysis of a model and prompt: what it says, how much of its evidence (JSON) stands in the document,
    and empty columns for a reviewer; in the order of days, codes and documents."""
    text = documents.select("document_id", "title", squeeze(F.coalesce("text_content", F.lit(""))).alias("_text"))
    a = analyses.where((F.col("model") == model) & (F.col("prompt_version") == prompt)).join(text, "document_id").join(securities.select("canonical_code", "company_name", "sector33_name"), "canonical_code", "left")
    a = a.withColumn("_said", F.coalesce(F.from_json(F.coalesce("evidence", F.lit("[]")), EVIDENCE), F.array().cast(EVIDENCE)))
    found = F.size(F.filter("_said", lambda e: F.contains(F.col("_text"), squeeze(F.coalesce(e["excerpt"], F.lit(""))))))
    a = a.withColumns({"evidence_count": F.size("_said").cast("long"), "evidence_found": found.cast("long")}).orderBy("disclosure_date", "canonical_code", "document_id")
    rate = F.when(F.col("evidence_count") > 0, F.col("evidence_found") / F.col("evidence_count")).otherwise(0.0)
    return a.select(
        "canonical_code", "company_name", "sector33_name", "disclosure_date", "title", "summary", *WEIGHTS, F.col("confidence").alias("validated_confidence"), "evidence_count", "evidence_found", rate.alias("evidence_match_rate"),
        "input_tokens", "output_tokens", "source_url", F.to_json("_said").alias("evidence_json"), *[F.lit("").alias(c) for c in REVIEW],
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row over all rows of an evaluation; zeros where there are none."""
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("canonical_code").alias("companies"), F.countDistinct("sector33_name").alias("sectors"), zero(F.sum("evidence_count")).alias("evidence_items"),
        zero(F.try_divide(F.sum("evidence_found"), F.sum("evidence_count")), 0.0).alias("evidence_match_rate"), zero(F.avg("validated_confidence"), 0.0).alias("average_confidence"),
        zero(F.sum("input_tokens")).cast("long").alias("input_tokens"), zero(F.sum("output_tokens")).cast("long").alias("output_tokens"),
    )


def qualitative_features(analyses: DataFrame, snapshot_date: str) -> DataFrame:
    """Of each code's analyses up to the date: the weighted score of the latest (by date, importance, time of analysis),
    and how many documents there were."""
    known = analyses.where(F.col("disclosure_date").try_cast("date") <= F.lit(snapshot_date).cast("date"))
    rank = F.lit(0)
    if "document_type" in analyses.columns:
        for name, p in PRIORITY.items():
            rank = F.when(F.col("document_type") == name, p).otherwise(rank)
    newest = F.struct(F.col("disclosure_date").try_cast("date").alias("d"), rank.alias("p"), F.col("analyzed_at").alias("t"), "document_id")
    g = known.groupBy("canonical_code").agg(F.max_by(F.struct("disclosure_date", "confidence", *WEIGHTS), newest).alias("x"), F.countDistinct("document_id").alias("document_count"))
    score = sum((F.col(f"x.{c}").cast("double") * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return g.select(
        F.lit(snapshot_date).cast("date").alias("snapshot_date"), "canonical_code", F.col("x.disclosure_date").try_cast("date").alias("disclosure_date"), score.alias("qualitative_score"), *[F.col(f"x.{c}") for c in WEIGHTS],
        F.col("x.confidence").alias("qualitative_confidence"), "document_count", F.lit(QUALITATIVE_VERSION).alias("feature_version"),
    )


def first_per_key(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order (a window filter that Catalyst limits before the shuffle)."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
