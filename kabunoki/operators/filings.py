"""Financial filings: same-day coalescing, and point-in-time fundamentals.

Coalescing groups by disclosure date, so it commutes with "known by that date": it is done once for all dates. Filings
are then collected once per code, in their total order, and each evaluation date looks at the part it may know; dates
multiply the small grid, never the filings' shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.functions.kit import canonical_code, clock_seconds, finite, growth
from kabunoki.session import width

FUNDAMENTAL_VERSION = "fundamental_1"
#: Results, balance, cash flows, forecasts; what a frame lacks is left out.
ACTUAL = "sales eps net_income ordinary_profit operating_profit".split()
AMOUNTS = ACTUAL + "bps roe equity equity_ratio total_assets shares_outstanding cash_and_equivalents cash_flow_investing cash_flow_financing cash_flow_operating".split()
AMOUNTS += [f"forecast_{c}" for c in ACTUAL]
PERIOD = "code disclosure_date current_period_type current_period_end current_fiscal_year_end".split()
RATIOS = "per pbr roe equity_ratio operating_margin sales_yoy eps_yoy operating_profit_yoy forecast_eps_revision".split()


def coalesce_same_day(filings: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each code, disclosure date and accounting period: the most complete row, overlaid with the latest
    non-null amounts of the day, and the latest row's time, number and retrieval. ``also``: columns that follow from the
    code, by which the rows may be partitioned already."""
    period = [*also, *PERIOD]
    amounts = [c for c in AMOUNTS if c in filings.columns]
    latest_of = [c for c in ("disclosure_time", "disclosure_number", "retrieved_at") if c in filings.columns]
    f = filings.withColumns({c: finite(F.col(c).cast("double")) for c in amounts})
    if "disclosure_time" not in f.columns:
        f = f.withColumn("disclosure_time", F.lit(None).cast("string"))
    if "disclosure_number" not in f.columns:
        f = f.withColumn("disclosure_number", F.lit("").cast("string"))
    f = f.withColumns({"_count": sum((F.col(c).isNotNull().cast("int") for c in amounts), F.lit(0)), "_time": clock_seconds(F.col("disclosure_time")), "_number": F.coalesce(F.col("disclosure_number").cast("string"), F.lit(""))})
    recent = [F.desc("_time"), F.desc("_number")] + ([F.col("retrieved_at").desc_nulls_last()] if "retrieved_at" in f.columns else [])
    newest = W.partitionBy(*period).orderBy(*recent)
    whole = newest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    best = W.partitionBy(*period).orderBy(F.desc("_count"), *recent)
    f = f.withColumns({f"_v_{c}": F.first(c, ignorenulls=True).over(whole) for c in amounts} | {f"_l_{c}": F.first(c).over(whole) for c in latest_of} | {"_rank": F.row_number().over(best)})
    out = f.where("_rank = 1").withColumns({c: F.col(f"_v_{c}") for c in amounts} | {c: F.col(f"_l_{c}") for c in latest_of})
    return out.select(*filings.columns)


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def histories(filings: DataFrame) -> DataFrame:
    """(canonical_code, history): coalesced filings of each code in their total order, nulls last."""
    # One shuffle, by canonical code, for the coalescing and the lists.
    f = filings.withColumn("canonical_code", canonical_code(F.col("code").cast("string"))).repartition(width(filings.sparkSession), "canonical_code")
    f = coalesce_same_day(f, ("canonical_code",))
    order = "disclosure_date disclosure_time current_period_end current_fiscal_year_end current_period_type disclosure_number".split()
    key = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c).alias(c))])
    for c in AMOUNTS:
        if c not in f.columns and c in ("sales", "eps", "operating_profit", "bps", "roe", "equity_ratio", "forecast_eps"):
            f = f.withColumn(c, F.lit(None).cast("double"))
    actual = [F.col(c) for c in ACTUAL if c in f.columns]
    row = F.struct(
        key.alias("key"), "disclosure_date", F.col("current_period_type").alias("kind"), F.col("current_period_end").alias("period"), F.col("current_fiscal_year_end").alias("year"),
        F.coalesce(*actual).isNotNull().alias("result"), "sales", "eps", "operating_profit", "bps", "roe", "equity_ratio", "forecast_eps",
    )
    return f.where("disclosure_date IS NOT NULL").groupBy("canonical_code").agg(F.array_sort(F.collect_list(row)).alias("history"))


def fundamentals(filings: DataFrame, prices: DataFrame) -> DataFrame:
    """Fundamental features for each (snapshot_date, canonical_code) of ``prices`` (with price_date and latest_close)
    that has a filing by then."""
    g = prices.select("snapshot_date", "canonical_code", "price_date", finite(F.col("latest_close")).alias("latest_price")).join(histories(filings), "canonical_code")
    g = g.withColumn("known", F.filter("history", lambda f: f["disclosure_date"] <= F.col("snapshot_date"))).where(F.size("known") > 0).drop("history")
    known = F.col("known")
    g = g.withColumn("last", F.coalesce(_last(F.filter(known, lambda f: f["result"])), _last(known)))
    g = g.withColumns(
        {
            "before": _last(F.filter(known, lambda f: (f["kind"] == F.col("last.kind")) & (f["period"] < F.col("last.period")))),
            "forecasts": F.filter(known, lambda f: f["forecast_eps"].isNotNull()),
        }
    ).withColumn("said", _last(F.col("forecasts")))
    same = F.filter("forecasts", lambda f: f["year"] == F.col("said.year"))
    newest = lambda c, of=known: _last(F.filter(of, lambda f: f[c].isNotNull()))[c]
    g = g.withColumns({"said_before": F.when(F.size(same) >= 2, F.get(same, F.size(same) - 2)["forecast_eps"]), "full_year": newest("eps", F.filter(known, lambda f: f["kind"] == "FY")), "bps": newest("bps"), "roe": newest("roe"), "equity_ratio": newest("equity_ratio")})
    forecast = F.col("said.forecast_eps")
    earnings = F.when(forecast > 0, forecast).otherwise(F.col("full_year"))
    yoy = lambda c: growth(F.col(f"last.{c}"), F.col(f"before.{c}"))
    g = g.withColumns(
        {
            "disclosure_date": F.greatest("last.disclosure_date", "said.disclosure_date"), "current_period_type": F.col("last.kind"), "eps": F.col("last.eps"),
            "operating_margin": F.try_divide("last.operating_profit", "last.sales"), "sales_yoy": yoy("sales"), "operating_profit_yoy": yoy("operating_profit"), "eps_yoy": yoy("eps"),
            "forecast_eps_revision": growth(forecast, F.col("said_before")), "per": F.when(earnings > 0, F.col("latest_price") / earnings), "pbr": F.when(F.col("bps") > 0, F.col("latest_price") / F.col("bps")),
        }
    )
    g = g.withColumn("financial_completeness", sum((F.col(c).isNotNull().cast("int") for c in RATIOS), F.lit(0)) / 9.0)
    return g.select("snapshot_date", "canonical_code", "disclosure_date", "current_period_type", "price_date", "latest_price", "eps", "bps", *RATIOS, "financial_completeness", F.lit(FUNDAMENTAL_VERSION).alias("feature_version"))
