"""Rule ranks: winsorised percentile scores within sector and group, factors, blended scores, ranks and their reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.functions.kit import finite, percentile_rank, rank_desc, row_mean, winsorise
from kabunoki.operators import order
from kabunoki.session import stable, width

RANKING_VERSION = "rule_1"
LEAST_IN_SECTOR = 5
#: factor: label, weight over 6 months, weight over 12 months
FACTORS = {
    "valuation_score": ("Valuation", 0.10, 0.20),
    "quality_score": ("Quality", 0.10, 0.20),
    "growth_score": ("Growth", 0.15, 0.20),
    "earnings_score": ("Earnings", 0.25, 0.20),
    "momentum_score": ("Momentum", 0.30, 0.10),
    "risk_score": ("Risk", 0.10, 0.10),
}
QUALITATIVE = {"6m": 0.10, "12m": 0.08}
METRICS = {"per": False, "pbr": False} | dict.fromkeys("roe equity_ratio operating_margin sales_yoy operating_profit_yoy eps_yoy forecast_eps_revision".split(), True)
MEANS = {
    "valuation_score": "per pbr",
    "quality_score": "roe equity_ratio operating_margin",
    "growth_score": "sales_yoy operating_profit_yoy eps_yoy",
    "earnings_score": "forecast_eps_revision operating_profit_yoy eps_yoy",
}


def metric_scores(frame: DataFrame, metrics: dict[str, bool] = METRICS, date: str | None = None, key: str = "canonical_code") -> DataFrame:
    """``<metric>_score`` for each metric: 70 % its percentile within the sector, 30 % within the group, of values clipped
    to the group's 2.5 and 97.5 percentiles; ``date`` keeps cross-sections of different dates apart, and ``key`` tells the
    rows of a cross-section apart.

    The metrics are stacked, so that one shuffle by group and metric serves the windows over a group, which is in pieces if
    it is large, another those over its sectors, and the work spreads by metric too. The rest of a row meets its scores at
    the end."""
    frame = stable(frame, "scored")
    keys = [date, key] if date else [key]
    group = [*([date] if date else []), "model_group", "_metric"]
    names = list(metrics)
    stack = F.array(*[F.struct(F.lit(k).alias("_metric"), (finite(F.col(m).cast("double")) + 0.0).alias("_value")) for k, m in enumerate(names)])
    long = frame.select(*dict.fromkeys([*keys, "model_group", "sector33_name"]), F.explode(stack).alias("_s")).select("*", "_s.*").drop("_s")
    long = order.pieces(long, group, "_value", keys, order.clipped(order.cut(long, group, "_value"), long, group, "_value"))
    v = F.col("_value")
    # What was cut is clipped already; other groups are a piece each.
    long = long.withColumn("_value", F.coalesce(winsorise(F.when(~F.col("_cut"), v), order.piece(group)), v))
    # A metric of which less is better has its percentiles from the other end.
    less = F.col("_metric").isin(*[k for k, m in enumerate(names) if not metrics[m]])
    long = order.ranks(long, group, "_value")
    twice = 2 * F.col("_rank") + F.col("_ties") - 1
    long = long.withColumn("_wide", F.when(less, 2 * F.col("_n") + 2 - twice).otherwise(twice) / 2.0 / F.col("_n"))
    # Rows without a sector have no use for their ranks in it, and needn't meet.
    long = long.withColumns({"_value": F.when(less, -v).otherwise(v), "_apart": F.when(F.col("sector33_name").isNull(), F.pmod(F.xxhash64(*keys), F.lit(order.APART)))})
    sector = [*group, "sector33_name", "_apart"]
    long = long.select(*dict.fromkeys([*keys, *sector]), "_value", "_wide").repartition(width(frame.sparkSession), *sector)
    long = long.withColumns({"_narrow": percentile_rank(v, *sector), "_n": F.count(v).over(W.partitionBy(*sector))})
    enough = F.col("sector33_name").isNotNull() & (F.col("_n") >= LEAST_IN_SECTOR)
    score = (F.when(enough, F.col("_narrow")).otherwise(F.col("_wide")) * 0.7 + F.col("_wide") * 0.3) * 100
    rest = F.struct(*[F.col(f"`{c}`") for c in frame.columns])
    scored = long.select(*keys, "_metric", score.alias("score"), F.lit(None).cast(frame.schema).alias("_rest"))
    both = scored.unionByName(frame.select(*keys, F.lit(-1).alias("_metric"), F.lit(None).cast("double").alias("score"), rest.alias("_rest")))
    parts = both.repartition(width(frame.sparkSession), *keys).groupBy(*keys).agg(F.collect_list(F.struct("_metric", "score", "_rest")).alias("_parts"))
    of = lambda k: F.get(F.filter("_parts", lambda p: p["_metric"] == k), F.lit(0))
    return parts.select(of(-1)["_rest"].alias("_rest"), *[of(k)["score"].alias(f"{m}_score") for k, m in enumerate(names)]).select("_rest.*", *[f"{m}_score" for m in names])


def reasons(positive: bool) -> Column:
    """The three factors that add (or take) most to the 12-month score, as an array of structs."""
    rows = [F.struct(F.lit(label).alias("factor"), F.col(c).alias("score"), (F.lit(w) * (F.col(c) - 50.0)).alias("weight"), F.lit(k).alias("place")) for k, (c, (label, _, w)) in enumerate(FACTORS.items())]
    q = F.lit(QUALITATIVE["12m"]) * F.col("qualitative_confidence")
    rows.append(F.struct(F.lit("Qualitative").alias("factor"), F.col("qualitative_score").alias("score"), (q * (F.col("qualitative_score") - 50.0)).alias("weight"), F.lit(len(rows)).alias("place")))
    some = F.filter(F.array(*rows), lambda r: r["weight"] > 0 if positive else r["weight"] < 0)
    keyed = F.transform(some, lambda r: F.struct((-F.abs(F.bround(r["weight"], 1))).alias("k"), r["place"].alias("p"), r["factor"].alias("factor"), F.bround(r["score"], 1).alias("score"), F.bround(r["weight"], 1).alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, 3), lambda r: F.struct(r["factor"].alias("factor"), r["score"].alias("score"), r["contribution"].alias("contribution")))


def investment_ranks(securities: DataFrame, prices: DataFrame, fundamentals: DataFrame, qualitative: DataFrame | None = None, date: str = "snapshot_date") -> DataFrame:
    """Scores and ranks of securities, one cross-section for each ``date`` in ``prices``. Without qualitative features
    the score is neutral and has no weight."""
    f = securities.join(prices.select(date, "canonical_code", "price_date", "latest_close", "momentum_score", "risk_score"), "canonical_code")
    wanted = [c for c in ("disclosure_date", *METRICS, "financial_completeness") if c in fundamentals.columns]
    f = f.join(fundamentals.select(F.col("snapshot_date").alias(date), "canonical_code", *wanted), [date, "canonical_code"], "left")
    for c in (*METRICS, "financial_completeness"):
        if c not in wanted:
            f = f.withColumn(c, F.lit(None).cast("double"))
    if qualitative is not None:
        f = f.join(qualitative.select("canonical_code", F.col("disclosure_date").alias("qualitative_disclosure_date"), "qualitative_score", "qualitative_confidence"), "canonical_code", "left")
    else:
        f = f.withColumns({"qualitative_disclosure_date": F.lit(None).cast("date"), "qualitative_score": F.lit(None).cast("double"), "qualitative_confidence": F.lit(None).cast("double")})
    f = metric_scores(f, date=date)
    f = f.withColumns({c: F.coalesce(row_mean(*[F.col(f"{m}_score") for m in names.split()]), F.lit(50.0)) for c, names in MEANS.items()})
    neutral = dict.fromkeys("qualitative_score risk_score momentum_score".split(), 50.0) | {"qualitative_confidence": 0.0}
    f = f.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in neutral.items()} | {"confidence": 0.4 + 0.6 * F.coalesce(F.col("financial_completeness"), F.lit(0.0))})
    opinion = F.col("qualitative_confidence") * (F.col("qualitative_score") - 50.0)
    for k, horizon in enumerate(("6m", "12m")):
        raw = sum((F.col(c) * spec[1 + k] for c, spec in FACTORS.items()), F.lit(0.0))
        score = 50.0 + F.col("confidence") * (raw - 50.0) + QUALITATIVE[horizon] * opinion
        f = f.withColumn(f"score_{horizon}", F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)))
        f = f.withColumn(f"rank_{horizon}", rank_desc(F.col(f"score_{horizon}"), date))
    f = f.withColumns({"positive_reasons": F.to_json(reasons(True)), "negative_reasons": F.to_json(reasons(False)), "ranking_version": F.lit(RANKING_VERSION)})
    return f.withColumnRenamed("latest_close", "latest_price")


def top(ranks: DataFrame, n: int, horizon: str = "12m", by: Sequence[str] = ()) -> DataFrame:
    """The first n securities by rank, then code; of each group, if ``by`` is given."""
    order = [F.col(f"rank_{horizon}").asc_nulls_last(), F.col("canonical_code")]
    if not by:
        return ranks.orderBy(*order).limit(n)
    return ranks.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
