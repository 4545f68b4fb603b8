"""Bars of nations derived from line items, and the price queries on them, with their equivalents in SQL.

A nation's daily bar is made of the unit prices of the line items that its suppliers shipped that day. A few bars are
spoiled on purpose, by a rule on their key, so that every cleaning rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import settle
from kabunoki.operators import prices as P
from kabunoki.session import load


_LABELS = "label_start_date label_end_date_6m label_end_date_12m forward_return_6m forward_return_12m".split()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    items = load(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("trade_date"), price.alias("px"), "l_discount", "l_quantity")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    day = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"]).groupBy("s_nationkey", "trade_date").agg(
        settle(F.avg("px"), 4).alias("close"), settle(F.avg(F.col("px") * (1 - F.col("l_discount"))), 4).alias("adjusted_close"),
        settle(F.max("px"), 4).alias("high"), settle(F.min("px"), 4).alias("low"), F.sum("l_quantity").alias("volume"),
    )
    k = F.pmod(F.col("s_nationkey") * 7919 + F.datediff("trade_date", F.lit("1995-01-01").cast("date")) * 104729, F.lit(9973))
    huge = F.lit(1e10)
    return day.withColumn("k", k).select(
        "trade_date", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("canonical_code"), F.lit("items").alias("source"),
        F.when(F.col("k") == 6, huge).otherwise((F.col("high") + F.col("low")) / 2).alias("open"),
        F.when(F.col("k") == 0, F.col("low") * 0.5).when(F.col("k") == 6, huge).otherwise(F.col("high")).alias("high"),
        F.when(F.col("k") == 6, huge).otherwise(F.col("low")).alias("low"),
        F.when(F.col("k") == 3, -1.0).when(F.col("k") == 6, huge).otherwise(F.col("close")).alias("close"),
        F.when(F.col("k") == 1, -10.0).when(F.col("k") == 2, F.col("adjusted_close") * 50).when(F.col("k") == 5, F.lit(None)).when(F.col("k") == 6, huge).otherwise(F.col("adjusted_close")).alias("adjusted_close"),
        F.when(F.col("k") == 4, -F.col("volume")).when(F.col("k") == 6, 0.0).otherwise(F.col("volume")).alias("volume"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean(bars(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: settle(F.col(c), digits) for c in doubles}) if doubles else df


def longs(df: DataFrame) -> DataFrame:
    ints = [c for c, t in df.dtypes if t in ("int", "smallint", "tinyint")]
    return df.withColumns({c: F.col(c).cast("long") for c in ints}) if ints else df


def _clean_prices(s: SparkSession, d: str) -> DataFrame:
    return rounded(cleaned(s, d).drop("broken_rules", "cleaning_version"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.quality_events(cleaned(s, d)).drop("cleaning_version"))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return P.segments(cleaned(s, d)).select("canonical_code", "trade_date", "valid", "segment")


def calendar(s: SparkSession, d: str) -> DataFrame:
    return P.month_calendar(cleaned(s, d))


def price_rows(s: SparkSession, d: str) -> DataFrame:
    c = cleaned(s, d)
    return P.price_rows(c, P.month_calendar(c))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return rounded(price_rows(s, d).select("canonical_code", "evaluation_date", *_LABELS))


def _asof(s: SparkSession, d: str) -> DataFrame:
    return rounded(price_rows(s, d).drop("snapshot_date", *_LABELS))


QUERIES = {
    "daily_bars": lambda s, d: rounded(bars(s, d)),
    "clean_prices": _clean_prices,
    "quality_events": _events,
    "quality_summary": lambda s, d: P.quality_summary(P.quality_events(cleaned(s, d))),
    "segments": _segments,
    "price_features": lambda s, d: rounded(P.price_features(cleaned(s, d)).drop("feature_version")),
    "month_calendar": calendar,
    "forward_labels": _labels,
    "asof_features": _asof,
}


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.3718281828) / 1e{digits}"


BARS = f"""
day AS (
  SELECT s_nationkey AS nk, CAST(l_shipdate AS DATE) AS trade_date, {r('avg(l_extendedprice / l_quantity)', 4)} AS c,
    {r('avg(l_extendedprice / l_quantity * (1 - l_discount))', 4)} AS a, {r('max(l_extendedprice / l_quantity)', 4)} AS h,
    {r('min(l_extendedprice / l_quantity)', 4)} AS l, sum(l_quantity) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
keyed AS (SELECT *, (nk * 7919 + date_diff('day', DATE '1995-01-01', trade_date) * 104729) % 9973 AS k FROM day),
bars AS (
  SELECT trade_date, 'N' || nk AS canonical_code, 'items' AS source, CASE WHEN k = 6 THEN 1e10 ELSE (h + l) / 2 END AS open,
    CASE k WHEN 0 THEN l * 0.5 WHEN 6 THEN 1e10 ELSE h END AS high, CASE k WHEN 6 THEN 1e10 ELSE l END AS low,
    CASE k WHEN 3 THEN -1.0 WHEN 6 THEN 1e10 ELSE c END AS close,
    CASE k WHEN 1 THEN -10.0 WHEN 2 THEN a * 50 WHEN 5 THEN NULL WHEN 6 THEN 1e10 ELSE a END AS adjusted_close,
    CASE k WHEN 4 THEN -v WHEN 6 THEN 0 ELSE v END AS volume
  FROM keyed)"""
FLAGS = f"""{BARS},
flags AS (
  SELECT *, (open > 0 AND high > 0 AND low > 0 AND close > 0) AS sound,
    adjusted_close IS NULL AS f_unread, coalesce(adjusted_close <= 0, false) AS f_below,
    coalesce(adjusted_close > 0 AND close > 0 AND (adjusted_close / close < 0.001 OR adjusted_close / close > 10), false) AS f_ratio,
    (volume = 0 AND close > 1e9) AS f_scale, volume < 0 AS f_short
  FROM bars),
edged AS (SELECT *, sound AND (high < greatest(open, high, low, close) OR low > least(open, high, low, close)) AS f_edge, NOT sound AS f_wrong FROM flags),
outs AS (SELECT *, f_unread OR f_below OR f_ratio OR f_scale OR close <= 0 AS gone FROM edged),
cleaned AS (
  SELECT *, CASE WHEN sound THEN open END AS clean_open, CASE WHEN sound THEN CASE WHEN f_edge THEN greatest(open, high, low, close) ELSE high END END AS clean_high,
    CASE WHEN sound THEN CASE WHEN f_edge THEN least(open, high, low, close) ELSE low END END AS clean_low, CASE WHEN sound THEN close END AS clean_close,
    CASE WHEN NOT f_short THEN volume END AS clean_volume, CASE WHEN NOT gone THEN adjusted_close END AS return_price, CASE WHEN sound THEN close END AS valuation_price,
    CASE WHEN NOT gone THEN adjusted_close END AS model_price,
    CASE WHEN gone THEN 'excluded' WHEN f_edge OR f_wrong OR f_short THEN 'corrected' ELSE 'clean' END AS quality_status
  FROM outs)"""
EVENTS = f"""{FLAGS},
events AS (
  SELECT c.*, reason_code, severity, action FROM cleaned c CROSS JOIN LATERAL (
    SELECT * FROM (VALUES (f_edge, 'ohlc_boundary_error', 'warning', 'expand_ohlc_envelope'), (f_wrong, 'ohlc_nonpositive_or_nonfinite', 'error', 'null_ohlc'),
      (f_unread, 'adjusted_close_nonfinite', 'error', 'exclude_model_price'), (f_below, 'adjusted_close_nonpositive', 'error', 'exclude_model_price'),
      (f_ratio, 'adjustment_ratio_outlier', 'error', 'exclude_model_price'), (f_scale, 'zero_volume_scale_outlier', 'error', 'exclude_model_price'),
      (f_short, 'negative_volume', 'error', 'null_volume')) v(hit, reason_code, severity, action) WHERE hit))"""
SEGMENTS = f"""{FLAGS},
gaps AS (SELECT *, coalesce(return_price > 0, false) AS valid, coalesce(date_diff('day', lag(trade_date) OVER w, trade_date) > 10, false) AS gap FROM cleaned WINDOW w AS (PARTITION BY canonical_code ORDER BY trade_date)),
seg AS (SELECT *, CAST(sum(CASE WHEN NOT valid OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_code ORDER BY trade_date) AS BIGINT) AS segment FROM gaps)"""
HISTORY = f"""{SEGMENTS},
steps AS (SELECT *, return_price / lag(return_price) OVER w - 1 AS ret FROM seg WHERE valid WINDOW w AS (PARTITION BY canonical_code, segment ORDER BY trade_date)),
history AS (
  SELECT canonical_code, segment, trade_date, return_price, valuation_price,
    return_price / lag(return_price, 21) OVER w - 1 AS return_1m, return_price / lag(return_price, 63) OVER w - 1 AS return_3m,
    return_price / lag(return_price, 126) OVER w - 1 AS return_6m, return_price / lag(return_price, 252) OVER w - 1 AS return_12m,
    lag(return_price, 21) OVER w / lag(return_price, 252) OVER w - 1 AS momentum_12_1,
    stddev_samp(ret) OVER w20 * sqrt(252) AS volatility_20d, stddev_samp(ret) OVER w60 * sqrt(252) AS volatility_60d,
    CASE WHEN count(CASE WHEN ret < 0 THEN ret END) OVER w60 >= 2 THEN stddev_samp(CASE WHEN ret < 0 THEN ret END) OVER w60 * sqrt(252) END AS downside_volatility_60d,
    return_price / max(return_price) OVER w252 - 1 AS high_52w_distance, avg(clean_volume) OVER w20 AS average_volume_20d, avg(valuation_price * clean_volume) OVER w20 AS average_turnover_20d,
    row_number() OVER w AS pos
  FROM steps
  WINDOW w AS (PARTITION BY canonical_code, segment ORDER BY trade_date), w20 AS (PARTITION BY canonical_code, segment ORDER BY trade_date ROWS 19 PRECEDING),
    w60 AS (PARTITION BY canonical_code, segment ORDER BY trade_date ROWS 59 PRECEDING), w252 AS (PARTITION BY canonical_code, segment ORDER BY trade_date ROWS 251 PRECEDING))"""


def pct(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def mean(*xs: str) -> str:
    return "(" + " + ".join(f"coalesce({x}, 0)" for x in xs) + ") / nullif(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in xs) + ", 0)"


def fall(of: str) -> str:
    """Per row of ``of`` (code, segment, pos): the deepest fall of its last 252 prices below their running maximum."""
    return f"""(SELECT canonical_code, segment, pos, min(px / top - 1) AS max_drawdown_252d, count(*) AS n FROM (
    SELECT o.canonical_code, o.segment, o.pos, h.return_price AS px, max(h.return_price) OVER (PARTITION BY o.canonical_code, o.segment, o.pos ORDER BY h.pos) AS top
    FROM {of} o JOIN history h ON h.canonical_code = o.canonical_code AND h.segment = o.segment AND h.pos BETWEEN o.pos - 251 AND o.pos) GROUP BY 1, 2, 3)"""


_SCORES = f"""{mean('p3', 'p6', 'p12', 'p121')} * 100 AS momentum_score, {mean('1 - pvol', 'pfall')} * 100 AS risk_score"""


def _ranks(by: str) -> str:
    pairs = (("return_3m", "p3"), ("return_6m", "p6"), ("return_12m", "p12"), ("momentum_12_1", "p121"), ("volatility_60d", "pvol"), ("max_drawdown_252d", "pfall"))
    return ", ".join(f"{pct(x, by)} AS {n}" for x, n in pairs)


FEATURES = f"""{HISTORY},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_code ORDER BY trade_date DESC) AS rn FROM history) WHERE rn = 1),
drawn AS (SELECT l.*, f.max_drawdown_252d, (SELECT max(trade_date) FROM latest) AS snapshot_date FROM latest l JOIN {fall('latest')} f USING (canonical_code, segment, pos)),
ranked AS (SELECT *, {_ranks('snapshot_date')} FROM drawn),
scored AS (SELECT *, {_SCORES} FROM ranked),
features AS (SELECT *, 0.7 * momentum_score + 0.3 * risk_score AS price_score FROM scored)"""
CALENDAR = """
valid_days AS (SELECT DISTINCT trade_date FROM cleaned WHERE return_price > 0),
calendar AS (SELECT max(trade_date) AS evaluation_date FROM valid_days WHERE trade_date >= (SELECT min(trade_date) + INTERVAL 1 YEAR FROM valid_days) GROUP BY date_trunc('month', trade_date))"""


def _label(m: int) -> str:
    return f"""
i{m} AS (SELECT g.canonical_code, g.evaluation_date, min(h.trade_date) AS d FROM grid g JOIN history h ON h.canonical_code = g.canonical_code AND h.trade_date > g.evaluation_date AND h.trade_date <= g.evaluation_date + INTERVAL 10 DAY GROUP BY 1, 2),
o{m} AS (SELECT g.canonical_code, g.evaluation_date, min(h.trade_date) AS d FROM grid g JOIN history h ON h.canonical_code = g.canonical_code AND h.trade_date >= g.evaluation_date + INTERVAL {m} MONTH AND h.trade_date <= g.evaluation_date + INTERVAL {m} MONTH + INTERVAL 10 DAY GROUP BY 1, 2),
l{m} AS (SELECT i.canonical_code, i.evaluation_date, i.d AS label_start_date, CASE WHEN a.segment = b.segment THEN o.d END AS label_end_date_{m}m, CASE WHEN a.segment = b.segment THEN b.return_price / a.return_price - 1 END AS forward_return_{m}m
  FROM i{m} i JOIN history a ON a.canonical_code = i.canonical_code AND a.trade_date = i.d LEFT JOIN o{m} o ON o.canonical_code = i.canonical_code AND o.evaluation_date = i.evaluation_date LEFT JOIN history b ON b.canonical_code = o.canonical_code AND b.trade_date = o.d)"""


ROWS = f"""{HISTORY}, {CALENDAR},
grid AS (SELECT canonical_code, evaluation_date, max(trade_date) AS trade_date FROM history JOIN calendar ON trade_date <= evaluation_date AND date_diff('day', trade_date, evaluation_date) <= 10 GROUP BY 1, 2),
at_grid AS (SELECT h.*, g.evaluation_date FROM history h JOIN grid g ON g.canonical_code = h.canonical_code AND g.trade_date = h.trade_date),
at_keys AS (SELECT DISTINCT canonical_code, segment, pos FROM at_grid),
at_drawn AS (SELECT a.*, CASE WHEN f.n >= 2 THEN f.max_drawdown_252d END AS max_drawdown_252d FROM at_grid a JOIN {fall('at_keys')} f USING (canonical_code, segment, pos)),
at_ranked AS (SELECT *, {_ranks('evaluation_date')} FROM at_drawn),
at_scored AS (SELECT *, {_SCORES} FROM at_ranked), {_label(6)}, {_label(12)},
rows_ AS (SELECT a.*, l6.label_start_date, l6.label_end_date_6m, l6.forward_return_6m, l12.label_end_date_12m, l12.forward_return_12m FROM at_scored a LEFT JOIN l6 USING (canonical_code, evaluation_date) LEFT JOIN l12 USING (canonical_code, evaluation_date))"""
_RETURNS = "return_1m return_3m return_6m return_12m momentum_12_1 volatility_20d volatility_60d downside_volatility_60d max_drawdown_252d high_52w_distance average_turnover_20d momentum_score risk_score".split()
_BAR = "open high low close adjusted_close volume".split()
_list = lambda cs: ", ".join(f"{r(c)} AS {c}" for c in cs)

SQL = {
    "daily_bars": f"WITH {BARS} SELECT trade_date, canonical_code, source, {_list(_BAR)} FROM bars",
    "clean_prices": f"WITH {FLAGS} SELECT trade_date, canonical_code, source, quality_status, {_list([*_BAR, *'clean_open clean_high clean_low clean_close clean_volume return_price valuation_price model_price'.split()])} FROM cleaned",
    "quality_events": f"WITH {EVENTS} SELECT trade_date, canonical_code, source, {', '.join(f'{r(c)} AS original_{c}' for c in _BAR)}, {r('clean_high')} AS cleaned_high, {r('clean_low')} AS cleaned_low, {r('model_price')} AS model_price, {r('clean_volume')} AS cleaned_volume, reason_code, severity, action FROM events",
    "quality_summary": f"""WITH {EVENTS}, m AS (SELECT * FROM events UNION ALL SELECT * REPLACE ('all' AS reason_code) FROM events)
      SELECT reason_code, count(*) AS event_rows, count(DISTINCT (canonical_code, trade_date, source)) AS affected_rows, count(DISTINCT canonical_code) AS affected_codes,
      CAST(coalesce(sum(CASE WHEN action = 'exclude_model_price' THEN 1 ELSE 0 END), 0) AS BIGINT) AS excluded_model_rows FROM m GROUP BY 1""",
    "segments": f"WITH {SEGMENTS} SELECT canonical_code, trade_date, valid, segment FROM seg",
    "price_features": f"""WITH {FEATURES} SELECT snapshot_date, canonical_code, trade_date AS price_date, {r('CASE WHEN valuation_price > 0 THEN valuation_price END')} AS latest_close, {_list([*_RETURNS, 'average_volume_20d', 'price_score'])},
      CASE WHEN price_score IS NOT NULL THEN rank() OVER (ORDER BY price_score DESC NULLS LAST) END AS price_rank FROM features""",
    "month_calendar": f"WITH {FLAGS}, {CALENDAR} SELECT evaluation_date FROM calendar",
    "forward_labels": f"WITH {ROWS} SELECT canonical_code, evaluation_date, label_start_date, label_end_date_6m, {r('forward_return_6m')} AS forward_return_6m, label_end_date_12m, {r('forward_return_12m')} AS forward_return_12m FROM rows_",
    "asof_features": f"WITH {ROWS} SELECT canonical_code, evaluation_date, trade_date AS price_date, {r('CASE WHEN valuation_price > 0 THEN valuation_price END')} AS latest_close, {_list(_RETURNS)}, {r('CASE WHEN average_turnover_20d >= 0 THEN ln(1 + average_turnover_20d) END')} AS log_average_turnover_20d FROM rows_",
}
