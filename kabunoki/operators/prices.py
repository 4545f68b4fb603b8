"""Daily bars: cleaning with audit events, segments, price features, and point-in-time rows with forward labels.

A bar has trade_date, canonical_code, source, open, high, low, close, adjusted_close, volume. Cleaning never changes
these; it adds derived columns. Returns use ``return_price`` (adjusted), valuation uses ``valuation_price`` (quoted).

All windows are partitioned by code (and segment), so work spreads by code; cross-sections are partitioned by date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.functions.kit import finite, percentile_rank, rank_desc, row_mean
from kabunoki.session import width

CLEANING_VERSION = "clean_1"
FEATURE_VERSION = "price_1"
GAP_DAYS = 10
YEAR = 252
LAGS = {"return_1m": 21, "return_3m": 63, "return_6m": 126, "return_12m": 252}
PRICES = "open high low close".split()
SHAPES = "momentum_12_1 high_52w_distance max_drawdown_252d volatility_20d volatility_60d downside_volatility_60d".split()


def clean(bars: DataFrame) -> DataFrame:
    """Bars with clean prices, the status of each, and the rules that it broke (an array of structs)."""
    raw = {c: finite(F.col(c).cast("double")) for c in (*PRICES, "adjusted_close", "volume")}
    b = bars.withColumns({f"_{c}": v for c, v in raw.items()})
    four = [F.col(f"_{c}") for c in PRICES]
    adjusted, close, volume = F.col("_adjusted_close"), F.col("_close"), F.col("_volume")
    sound = F.lit(True)
    for c in four:
        sound = sound & F.coalesce(c > 0, F.lit(False))
    ratio = F.try_divide(adjusted, close)
    yes = lambda c: F.coalesce(c, F.lit(False))
    b = b.withColumns({"_sound": sound, "_top": F.greatest(*four), "_bottom": F.least(*four)})
    edge = F.col("_sound") & ((F.col("_high") < F.col("_top")) | (F.col("_low") > F.col("_bottom")))
    b = b.withColumns(
        {
            "_edge": edge,
            "_unread": adjusted.isNull(),
            "_below": yes(adjusted <= 0),
            "_ratio": yes((adjusted > 0) & (close > 0) & ~ratio.between(0.001, 10.0)),
            "_scale": yes((volume == 0) & (close > 1e9)),
            "_short": yes(volume < 0),
        }
    )
    # One short conjunction, not the flags: a filter on the price is pushed below these projections, written out.
    kept = yes((adjusted > 0) & (close > 0) & ratio.between(0.001, 10.0)) & ~F.col("_scale")
    price = lambda c, widened: F.when(F.col("_sound"), F.when(F.col("_edge"), widened).otherwise(F.col(c)))
    b = b.withColumns(
        {
            "clean_open": F.when(F.col("_sound"), F.col("_open")),
            "clean_high": price("_high", F.col("_top")),
            "clean_low": price("_low", F.col("_bottom")),
            "clean_close": F.when(F.col("_sound"), close),
            "clean_volume": F.when(~F.col("_short"), volume),
            "return_price": F.when(kept, adjusted),
            "_out": ~kept,
        }
    )
    rules = [
        ("_edge", "ohlc_boundary_error", "warning", "expand_ohlc_envelope"),
        ("_wrong", "ohlc_nonpositive_or_nonfinite", "error", "null_ohlc"),
        ("_unread", "adjusted_close_nonfinite", "error", "exclude_model_price"),
        ("_below", "adjusted_close_nonpositive", "error", "exclude_model_price"),
        ("_ratio", "adjustment_ratio_outlier", "error", "exclude_model_price"),
        ("_scale", "zero_volume_scale_outlier", "error", "exclude_model_price"),
        ("_short", "negative_volume", "error", "null_volume"),
    ]
    b = b.withColumns({"_wrong": ~F.col("_sound"), "valuation_price": F.col("clean_close"), "model_price": F.col("return_price")})
    broken = F.array(*[F.struct(F.col(flag).alias("hit"), F.lit(code).alias("reason_code"), F.lit(level).alias("severity"), F.lit(action).alias("action")) for flag, code, level, action in rules])
    b = b.withColumns(
        {
            "quality_status": F.when(F.col("_out"), "excluded").when(F.col("_edge") | F.col("_wrong") | F.col("_short"), "corrected").otherwise("clean"),
            "cleaning_version": F.lit(CLEANING_VERSION),
            "broken_rules": F.filter(broken, lambda r: r["hit"]),
        }
    )
    return b.drop(*[c for c in b.columns if c.startswith("_")])


def quality_events(cleaned: DataFrame) -> DataFrame:
    """One row for each rule that a bar broke."""
    original = [F.col(c).alias(f"original_{c}") for c in (*PRICES, "adjusted_close", "volume")]
    return (
        cleaned.where(F.size("broken_rules") > 0)
        .select(
            "trade_date", "canonical_code", "source", *original, F.col("clean_high").alias("cleaned_high"), F.col("clean_low").alias("cleaned_low"), "model_price",
            F.col("clean_volume").alias("cleaned_volume"), "cleaning_version", F.explode("broken_rules").alias("r"),
        )
        .select("*", "r.reason_code", "r.severity", "r.action").drop("r")
    )


def quality_summary(events: DataFrame) -> DataFrame:
    """Per reason, and for all reasons together (reason_code 'all'), how many events, bars, codes and exclusions."""
    measures = [
        F.count(F.lit(1)).alias("event_rows"), F.countDistinct(F.struct("canonical_code", "trade_date", "source")).alias("affected_rows"),
        F.countDistinct("canonical_code").alias("affected_codes"), F.coalesce(F.sum((F.col("action") == "exclude_model_price").cast("long")), F.lit(0)).alias("excluded_model_rows"),
    ]
    return events.groupBy("reason_code").agg(*measures).unionByName(events.agg(*measures).select(F.lit("all").alias("reason_code"), "*"))


def _usable(price: str) -> Column:
    return F.coalesce((F.col(price) > 0) & (F.col(price) < float("inf")), F.lit(False))


def segments(cleaned: DataFrame, price: str = "return_price") -> DataFrame:
    """Bars with ``segment``: a new one begins at each invalid price and after each gap of more than ten days. Of bars of
    one day the last source stays."""
    one = W.partitionBy("canonical_code", "trade_date").orderBy(F.col("source").desc_nulls_last() if "source" in cleaned.columns else F.lit(1))
    by_day = W.partitionBy("canonical_code").orderBy("trade_date")
    valid = _usable(price)
    # By code at once: all windows to come, by code and day or code and segment, keep this partitioning. Its number is given,
    # as windows take long for their bytes and few partitions would be made of them.
    return (
        cleaned.repartition(width(cleaned.sparkSession), "canonical_code").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        .withColumns({"valid": valid, "_gap": F.coalesce(F.datediff("trade_date", F.lag("trade_date").over(by_day)) > GAP_DAYS, F.lit(False))})
        .withColumn("segment", F.sum((~F.col("valid") | F.col("_gap")).cast("long")).over(by_day.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_gap")
    )


def _windows(x: str) -> dict[str, Column]:
    """Feature columns over (code, segment) in order of days; ``r`` is the one-step return."""
    by = W.partitionBy("canonical_code", "segment").orderBy("trade_date")
    last = lambda n: by.rowsBetween(1 - n, 0)
    r, p = F.col("_r"), F.col(x)
    year = math.sqrt(YEAR)
    out = {name: p / F.lag(p, k).over(by) - 1 for name, k in LAGS.items()}
    out["momentum_12_1"] = F.lag(p, 21).over(by) / F.lag(p, YEAR).over(by) - 1
    for n in (20, 60):
        out[f"volatility_{n}d"] = F.stddev_samp(r).over(last(n)) * year
    low = F.when(r < 0, r)
    out["downside_volatility_60d"] = F.stddev_samp(low).over(last(60)) * year
    out["high_52w_distance"] = p / F.max(p).over(last(YEAR)) - 1
    return out


def drawdown(history: Column, least: int) -> Column:
    """The deepest fall below the running maximum of an array of prices in order; null for less than ``least``."""
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("fall"))
    step = lambda s, v: F.struct(F.greatest(s["top"], v).alias("top"), F.least(s["fall"], v / F.greatest(s["top"], v) - 1).alias("fall"))
    return F.when(F.size(history) >= least, F.aggregate(history, start, step)["fall"])


def scores(features: DataFrame, date: str) -> DataFrame:
    """Momentum and risk scores of each date's cross-section."""
    pct = lambda c: percentile_rank(F.col(c), date)
    return features.withColumns(
        {
            "momentum_score": row_mean(*[pct(c) for c in "return_3m return_6m return_12m momentum_12_1".split()]) * 100,
            "risk_score": row_mean(1 - pct("volatility_60d"), pct("max_drawdown_252d")) * 100,
        }
    )


def price_features(cleaned: DataFrame) -> DataFrame:
    """The latest features of each code: from the last valid bar of its latest segment, ranked across codes."""
    seg = segments(cleaned)
    # Only the latest segment is of use; its windows are computed after the others have gone.
    latest = seg.withColumn("_top", F.max(F.when(F.col("valid"), F.col("segment"))).over(W.partitionBy("canonical_code"))).where("segment = _top").drop("_top")
    past = latest.where("valid")
    back = W.partitionBy("canonical_code").orderBy(F.desc("trade_date"))
    # 252 returns at most are looked back on, and one price more.
    past = past.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= YEAR + 1)
    by = W.partitionBy("canonical_code", "segment").orderBy("trade_date")
    month = by.rowsBetween(-19, 0)
    past = past.withColumn("_r", F.col("return_price") / F.lag("return_price").over(by) - 1).withColumns(_windows("return_price")).withColumns(
        {
            "average_volume_20d": F.avg("clean_volume").over(month), "average_turnover_20d": F.avg(F.col("valuation_price") * F.col("clean_volume")).over(month),
            "_past": F.when(F.col("_k") == 1, F.collect_list(F.when(F.col("_k") <= YEAR, F.col("return_price"))).over(by.rowsBetween(-YEAR, 0))),
        }
    )
    last = past.where("_k = 1").withColumns(
        {
            "price_date": F.col("trade_date"), "latest_close": F.when(F.col("valuation_price") > 0, F.col("valuation_price")), "max_drawdown_252d": drawdown(F.col("_past"), 1),
            "feature_version": F.lit(FEATURE_VERSION),
        }
    )
    last = last.crossJoin(F.broadcast(last.agg(F.max("trade_date").alias("snapshot_date"))))  # one row
    out = scores(last, "snapshot_date").withColumn("price_score", 0.7 * F.col("momentum_score") + 0.3 * F.col("risk_score"))
    out = out.withColumn("price_rank", rank_desc(F.col("price_score"), "snapshot_date"))
    return out.select(
        "snapshot_date", "canonical_code", "price_date", "latest_close", *LAGS, *SHAPES,
        "average_volume_20d", "average_turnover_20d", "momentum_score", "risk_score", "price_score", "price_rank", "feature_version",
    )


def month_calendar(cleaned: DataFrame, filings: DataFrame | None = None, period: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """The last valid trade date of each month, from a year after the first (and the first filing) on."""
    start, end = period
    days = cleaned.where(_usable("return_price"))
    # The bars are read once, for the first and last days of each month; all else is about months.
    until = F.when(F.col("trade_date") <= F.lit(end).cast("date"), F.col("trade_date")) if end else F.col("trade_date")
    months = days.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("first"), F.max(until).alias("evaluation_date"))
    limits = months.agg(F.add_months(F.min("first"), 12).alias("lo"))
    if filings is not None:
        limits = limits.crossJoin(filings.agg(F.min("disclosure_date").alias("filed"))).select(F.greatest("lo", "filed").alias("lo"))
    lo = F.lit(start).cast("date") if start else F.col("lo")
    return months.crossJoin(F.broadcast(limits)).where(F.col("evaluation_date") >= lo).select("evaluation_date")  # one row


def _by_month(calendar: DataFrame) -> DataFrame:
    """One row: the number of the first month, and the evaluation date of each month from it on, null where there is none."""
    number = F.year("evaluation_date") * 12 + F.month("evaluation_date")
    months = calendar.select(number.alias("k"), "evaluation_date")
    some = months.agg(F.min("k").alias("_first"), F.max("k").alias("_last"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "evaluation_date")))).alias("_days"))
    return some.select("_first", F.transform(F.sequence("_first", "_last"), lambda k: F.element_at("_days", k)).alias("_months"))


def _evaluated(day: Column, months_before: int = 0) -> Column:
    """The evaluation date of the month so many before a day's."""
    place = F.year(day) * 12 + F.month(day) - F.lit(months_before) - F.col("_first")
    return F.when(place >= 0, F.get("_months", place))


def _near(candidates: list[Column], holds) -> Column:
    """The distinct candidates that hold."""
    return F.array_distinct(F.filter(F.array(*candidates), lambda e: e.isNotNull() & holds(e)))


def _served(bars: DataFrame, calendar: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Valid bars with the evaluation dates that each serves: ``_grid`` as the latest bar of its code by then, and
    ``_exit_<m>`` as the first on or after the date m months later; ten days at most lie between. ``_next`` is the bar
    after it. A bar looks up the two months that can be meant, so neither bars nor months are joined by range."""
    by = W.partitionBy("canonical_code").orderBy("trade_date")
    d, early = F.col("trade_date"), F.date_sub("trade_date", GAP_DAYS)
    b = bars.withColumns({"_next": F.lead(F.struct("trade_date", "return_price", "segment")).over(by), "_before": F.lag("trade_date").over(by)}).crossJoin(F.broadcast(_by_month(calendar)))  # one row
    grid = lambda e: (e >= d) & (F.datediff(e, d) <= GAP_DAYS) & (F.col("_next").isNull() | (e < F.col("_next.trade_date")))
    out = {"_grid": _near([_evaluated(d), _evaluated(F.date_add(d, GAP_DAYS))], grid)}
    for m in horizons:

        def serves(e: Column, m: int = m) -> Column:
            t = F.add_months(e, m)
            return (t <= d) & (t >= early) & (F.col("_before").isNull() | (t > F.col("_before")))

        out[f"_exit_{m}"] = _near([_evaluated(early, m), _evaluated(d, m)], serves)
    return b.withColumns(out).drop("_first", "_months", "_before")


def _labels(entry: Column, exits: Column, months: int, date: Column) -> dict[str, Column]:
    """``entry``: the bar after the evaluation date; ``exits``: the bar that closes the label."""
    there = F.datediff(entry["trade_date"], date) <= GAP_DAYS
    whole = there & exits.isNotNull() & (entry["segment"] == exits["segment"])
    return {
        "label_start_date": F.when(there, entry["trade_date"]), f"label_end_date_{months}m": F.when(whole, exits["trade_date"]),
        f"forward_return_{months}m": F.when(whole, exits["return_price"] / entry["return_price"] - 1),
    }


def forward_labels(seg: DataFrame, grid: DataFrame, months: int) -> DataFrame:
    """For (canonical_code, evaluation_date): entry at the first valid bar after the date, exit at the first on or after
    the date ``months`` later, both within ten days and in one segment. Bars and dates meet by code and month."""
    bars = seg.where("valid").select("canonical_code", F.col("trade_date").alias("d"), "return_price", "segment")
    bars = bars.withColumn("m", F.explode(F.array_distinct(F.array(F.trunc(F.date_sub("d", GAP_DAYS), "month"), F.trunc("d", "month")))))
    wanted = F.array(F.struct(F.lit(True).alias("entry"), F.col("evaluation_date").alias("t")), F.struct(F.lit(False).alias("entry"), F.add_months("evaluation_date", months).alias("t")))
    asked = grid.select("canonical_code", "evaluation_date", F.explode(wanted).alias("x")).select("canonical_code", "evaluation_date", "x.*", F.trunc("x.t", "month").alias("m"))
    near = asked.join(bars, ["canonical_code", "m"]).where((F.col("d") > F.col("t")) & F.col("entry") | (F.col("d") >= F.col("t")) & ~F.col("entry")).where(F.datediff("d", "t") <= GAP_DAYS)
    pick = F.struct(F.col("d").alias("trade_date"), "return_price", "segment")
    found = near.groupBy("canonical_code", "evaluation_date").agg(F.min(F.when(F.col("entry"), pick)).alias("i"), F.min(F.when(~F.col("entry"), pick)).alias("o")).where("i IS NOT NULL")
    labels = _labels(F.col("i"), F.col("o"), months, F.col("evaluation_date"))
    return found.select("canonical_code", "evaluation_date", *[c.alias(name) for name, c in labels.items()])


def price_rows(cleaned: DataFrame, calendar: DataFrame) -> DataFrame:
    """Point-in-time features of each code at each evaluation date, with 6 and 12 month labels. One pass over the bars,
    by code; only bars that an evaluation date looks back from carry their past prices beyond the window."""
    by = W.partitionBy("canonical_code", "segment").orderBy("trade_date")
    month = by.rowsBetween(-19, 0)
    horizons = (6, 12)
    valid = _served(segments(cleaned).where("valid"), calendar, horizons)
    valid = valid.withColumn("_r", F.col("return_price") / F.lag("return_price").over(by) - 1).withColumns(_windows("return_price")).withColumns(
        {
            "average_turnover_20d": F.avg(finite(F.col("valuation_price")) * F.col("clean_volume")).over(month),
            "_place": F.row_number().over(by), "_at": F.struct("trade_date", "return_price", "segment"),
        }
    )
    valid = valid.withColumn("_past", F.when(F.size("_grid") > 0, F.collect_list("return_price").over(by.rowsBetween(1 - YEAR, 0))))
    valid = valid.withColumn("max_drawdown_252d", drawdown(F.col("_past"), 2))
    kept = ["canonical_code", "trade_date", "valuation_price", *LAGS, *SHAPES, "average_turnover_20d", "_next"]
    row = F.struct(*[F.col(c) for c in kept])
    kind = lambda k, dates, at: F.transform(dates, lambda e: F.struct(e.alias("evaluation_date"), F.lit(k).alias("kind"), at.alias("row"), F.col("_at").alias("bar")))
    none = F.lit(None).cast(valid.select(row.alias("r")).schema["r"].dataType)
    events = F.concat(kind(0, F.col("_grid"), row), *[kind(m, F.col(f"_exit_{m}"), none) for m in horizons])
    told = valid.select("canonical_code", F.explode(events).alias("e")).select("canonical_code", "e.*")
    one = told.groupBy("canonical_code", "evaluation_date").agg(
        F.first(F.when(F.col("kind") == 0, F.col("row")), ignorenulls=True).alias("x"), *[F.first(F.when(F.col("kind") == m, F.col("bar")), ignorenulls=True).alias(f"o{m}") for m in horizons]
    )
    at = one.where("x IS NOT NULL").withColumns({k: c for m in reversed(horizons) for k, c in _labels(F.col("x._next"), F.col(f"o{m}"), m, F.col("evaluation_date")).items()})
    at = at.select("evaluation_date", "x.*", "label_start_date", *[f"{c}_{m}m" for m in horizons for c in ("label_end_date", "forward_return")]).withColumns(
        {
            "snapshot_date": F.col("evaluation_date"), "price_date": F.col("trade_date"), "latest_close": F.when(F.col("valuation_price") > 0, F.col("valuation_price")),
            "log_average_turnover_20d": F.when(F.col("average_turnover_20d") >= 0, F.log1p("average_turnover_20d")),
        }
    )
    return scores(at, "evaluation_date").select(
        "evaluation_date", "snapshot_date", "canonical_code", "price_date", "latest_close", *LAGS, *SHAPES,
        "average_turnover_20d", "log_average_turnover_20d", "momentum_score", "risk_score", *"label_start_date label_end_date_6m label_end_date_12m forward_return_6m forward_return_12m".split(),
    )
