"""Filings of customers derived from orders, fundamentals, scores and ranks, with their equivalents in SQL.

Each order of a customer is a filing about the quarter it was placed in, disclosed 40 days after the quarter's end; so
several filings of a customer fall on one day and period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import settle
from kabunoki.operators import filings as L
from kabunoki.operators import order
from kabunoki.operators import ranking as R
from kabunoki.plans.market import longs, mean, pct, r, rounded
from kabunoki.session import load, stable

DATES = ("1997-12-31", "1999-06-30", "2001-12-31")


def _four(key: str) -> F.Column:
    c = F.col(key).cast("string")
    return F.when(F.length(c) < 4, F.lpad(c, 4, "0")).otherwise(c)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    end = F.date_sub(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 3), 1)
    unless = lambda n, v: F.when(k % n != 0, v)
    clock = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00"))
    return o.select(
        F.concat(_four("o_custkey"), F.lit("0")).alias("code"), F.date_add(end, 40).alias("disclosure_date"),
        F.when(k % 13 == 0, "n/a").when(k % 11 != 0, clock).alias("disclosure_time"), k.cast("string").alias("disclosure_number"), F.concat(F.lit("D"), (k % 3).cast("string")).alias("document_type"),
        F.when(F.quarter(end) == 4, "FY").otherwise(F.concat(F.quarter(end).cast("string"), F.lit("Q"))).alias("current_period_type"), end.alias("current_period_end"),
        F.make_date(F.year(end), F.lit(12), F.lit(31)).alias("current_fiscal_year_end"), unless(7, total).alias("sales"), unless(3, total * ((k % 5) - 1)).alias("operating_profit"),
        unless(4, total / (1000 + F.col("o_custkey") % 10 * 100)).alias("eps"), unless(6, total / 100).alias("bps"), ((k % 50) / 100.0).alias("roe"), unless(5, (k % 100) / 100.0).alias("equity_ratio"),
        unless(2, total / 900).alias("forecast_eps"),
    )


def _grid(spark: SparkSession, sf_dir: str, dates: tuple[str, ...]) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    code = _four("c_custkey")
    day = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    return c.select(
        day.alias("snapshot_date"), F.when(F.length(code) > 4, F.concat(code, F.lit("0"))).otherwise(code).alias("canonical_code"), F.lit("1995-01-01").cast("date").alias("price_date"),
        (1000 + F.col("c_acctbal")).alias("latest_close"), F.when(k % 17 != 0, (k * 37 % 101).cast("double")).alias("momentum_score"), F.when(k % 19 != 0, (k * 53 % 97).cast("double")).alias("risk_score"),
        F.col("c_mktsegment").alias("model_group"), F.when(k % 23 != 0, F.col("c_nationkey").cast("string")).alias("sector33_name"), F.concat(F.lit("Customer "), k.cast("string")).alias("company_name"),
    )


def fundamentals(s: SparkSession, d: str) -> DataFrame:
    return L.fundamentals(filings(s, d), _grid(s, d, DATES))


def ranks(s: SparkSession, d: str, dates: tuple[str, ...] = DATES) -> DataFrame:
    g = _grid(s, d, dates)
    who = _grid(s, d, DATES[:1]).select("canonical_code", "company_name", "sector33_name", "model_group")
    q = who.where(F.hash("canonical_code").isNotNull() & (F.substring("canonical_code", -1, 1) == "3")).select(
        "canonical_code", F.lit("1997-01-01").cast("date").alias("disclosure_date"), F.lit(80.0).alias("qualitative_score"), F.lit(0.5).alias("qualitative_confidence")
    )
    return R.investment_ranks(who, g, L.fundamentals(filings(s, d), g), q)


def _scores(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer")
    base = c.select("c_custkey", F.col("c_mktsegment").alias("model_group"), F.col("c_nationkey").cast("string").alias("sector33_name"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("per"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal") % 97).alias("roe"))
    return rounded(R.metric_scores(base, {"per": False, "roe": True}, key="c_custkey").select("c_custkey", "per_score", "roe_score"))


def _ranks(s: SparkSession, d: str) -> DataFrame:
    names = [*R.FACTORS, "qualitative_score", "qualitative_confidence", "confidence", "score_6m", "score_12m"]
    return longs(rounded(ranks(s, d).select("snapshot_date", "canonical_code", *names)))


def _places(s: SparkSession, d: str) -> DataFrame:
    # Ranks of settled scores: two engines add in different orders, and a last bit must not decide between equals.
    keys, horizons = ["snapshot_date", "canonical_code"], ("6m", "12m")
    x = stable(_ranks(s, d).select(*keys, *[f"score_{h}" for h in horizons]), "scores")
    return order.places(x.toDF(*keys, *[f"rank_{h}" for h in horizons]), [f"rank_{h}" for h in horizons], keys[:1], keys)


def _reasons(s: SparkSession, d: str) -> DataFrame:
    # Scores are settled and moved off the halves between tenths, so that both engines round them alike.
    x = ranks(s, d, DATES[-1:])
    x = x.withColumns({c: settle(F.col(c)) + 0.0137 for c in (*R.FACTORS, "qualitative_score")})
    tenths = lambda c: F.round(c * 10).cast("long").cast("string")
    told = lambda up: F.array_join(F.transform(R.reasons(up), lambda f: F.concat(f["factor"], F.lit("="), tenths(f["score"]), F.lit("/"), tenths(f["contribution"]))), ",")
    return x.select("canonical_code", told(True).alias("positive"), told(False).alias("negative"))


QUERIES = {
    "filings": lambda s, d: rounded(L.coalesce_same_day(filings(s, d))),
    "fundamentals_pit": lambda s, d: rounded(fundamentals(s, d).drop("feature_version")),
    "metric_scores": _scores,
    "rule_rank": _ranks,
    "rank_places": _places,
    "reasons_topk": _reasons,
}

_AMOUNTS = "sales operating_profit eps bps roe equity_ratio forecast_eps".split()
_KEY = "code, disclosure_date, current_period_type, current_period_end, current_fiscal_year_end"
FILED = f"""
raw AS (
  SELECT CASE WHEN o_custkey < 1000 THEN lpad(CAST(o_custkey AS VARCHAR), 4, '0') ELSE CAST(o_custkey AS VARCHAR) END || '0' AS code, o_orderkey AS k, o_totalprice AS t, o_custkey AS ck,
    CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS pe FROM orders),
filed AS (
  SELECT code, CAST(pe + INTERVAL 40 DAY AS DATE) AS disclosure_date, CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 11 <> 0 THEN lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00' END AS disclosure_time,
    CAST(k AS VARCHAR) AS disclosure_number, 'D' || (k % 3) AS document_type, CASE quarter(pe) WHEN 4 THEN 'FY' ELSE quarter(pe) || 'Q' END AS current_period_type, pe AS current_period_end,
    make_date(year(pe), 12, 31) AS current_fiscal_year_end, CASE WHEN k % 7 <> 0 THEN t END AS sales, CASE WHEN k % 3 <> 0 THEN t * ((k % 5) - 1) END AS operating_profit,
    CASE WHEN k % 4 <> 0 THEN t / (1000 + ck % 10 * 100) END AS eps, CASE WHEN k % 6 <> 0 THEN t / 100 END AS bps, CAST((k % 50) / 100.0 AS DOUBLE) AS roe,
    CASE WHEN k % 5 <> 0 THEN CAST((k % 100) / 100.0 AS DOUBLE) END AS equity_ratio, CASE WHEN k % 2 <> 0 THEN t / 900 END AS forecast_eps FROM raw),
timed AS (SELECT *, CASE WHEN disclosure_time IS NULL THEN 0 WHEN disclosure_time = 'n/a' THEN -1 ELSE CAST(disclosure_time[1:2] AS INT) * 3600 + CAST(disclosure_time[4:5] AS INT) * 60 END AS tm,
  {' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in _AMOUNTS)} AS n FROM filed),
merged AS (
  SELECT {_KEY}, arg_max(document_type, (n, tm, disclosure_number)) AS document_type, arg_max_null(disclosure_time, (tm, disclosure_number)) AS disclosure_time, arg_max(disclosure_number, (tm, disclosure_number)) AS disclosure_number,
    {', '.join(f'arg_max({c}, (tm, disclosure_number)) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in _AMOUNTS)} FROM timed GROUP BY ALL)"""
GRID = f"""
grid AS (
  SELECT CAST(d AS DATE) AS snapshot_date, CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 4 THEN c_custkey || '0' ELSE lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS canonical_code, 1000 + c_acctbal AS latest_price,
    CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey * 37 % 101 AS DOUBLE) END AS momentum, CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_custkey * 53 % 97 AS DOUBLE) END AS risk,
    c_mktsegment AS model_group, CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS sector33_name
  FROM customer, (VALUES {', '.join(f"('{d}')" for d in DATES)}) v(d))"""
_G = lambda a, b: f"CASE WHEN abs({b}) >= 1e-12 THEN ({a} - {b}) / abs({b}) END"
_PIT = f"""
known AS (
  SELECT g.snapshot_date, g.canonical_code, g.latest_price, m.* EXCLUDE (code), coalesce(sales, operating_profit, eps) IS NOT NULL AS result,
    row_number() OVER (PARTITION BY g.snapshot_date, g.canonical_code ORDER BY disclosure_date, disclosure_time NULLS LAST, current_period_end, current_fiscal_year_end, current_period_type, disclosure_number) AS rn
  FROM grid g JOIN merged m ON g.canonical_code = CASE WHEN length(m.code) = 5 AND m.code[-1] = '0' THEN m.code[1:4] ELSE m.code END AND m.disclosure_date <= g.snapshot_date),
picked AS (SELECT snapshot_date, canonical_code, coalesce(max(rn) FILTER (WHERE result), max(rn)) AS rl, max(rn) FILTER (WHERE forecast_eps IS NOT NULL) AS rf,
  arg_max(eps, rn) FILTER (WHERE current_period_type = 'FY' AND eps IS NOT NULL) AS fy, arg_max(bps, rn) FILTER (WHERE bps IS NOT NULL) AS bps, arg_max(roe, rn) FILTER (WHERE roe IS NOT NULL) AS roe,
  arg_max(equity_ratio, rn) FILTER (WHERE equity_ratio IS NOT NULL) AS equity_ratio FROM known GROUP BY 1, 2),
prior AS (SELECT k.snapshot_date, k.canonical_code, max(k.rn) AS rp FROM known k JOIN picked p USING (snapshot_date, canonical_code) JOIN known l ON l.snapshot_date = k.snapshot_date AND l.canonical_code = k.canonical_code AND l.rn = p.rl
  WHERE k.current_period_type = l.current_period_type AND k.current_period_end < l.current_period_end GROUP BY 1, 2),
told AS (SELECT k.snapshot_date, k.canonical_code, max(k.rn) AS rg FROM known k JOIN picked p USING (snapshot_date, canonical_code) JOIN known l ON l.snapshot_date = k.snapshot_date AND l.canonical_code = k.canonical_code AND l.rn = p.rf
  WHERE k.forecast_eps IS NOT NULL AND k.rn < p.rf AND k.current_fiscal_year_end = l.current_fiscal_year_end GROUP BY 1, 2),
pieces AS (SELECT l.snapshot_date, l.canonical_code, l.latest_price, l.disclosure_date AS dl, f.disclosure_date AS df, l.current_period_type, l.sales, l.operating_profit, l.eps, b.sales AS sales0, b.operating_profit AS op0, b.eps AS eps0, f.forecast_eps AS fc, t.forecast_eps AS fc0, p.fy, p.bps, p.roe, p.equity_ratio
  FROM picked p JOIN known l ON l.snapshot_date = p.snapshot_date AND l.canonical_code = p.canonical_code AND l.rn = p.rl LEFT JOIN prior r ON r.snapshot_date = p.snapshot_date AND r.canonical_code = p.canonical_code
  LEFT JOIN known b ON b.snapshot_date = p.snapshot_date AND b.canonical_code = p.canonical_code AND b.rn = r.rp LEFT JOIN known f ON f.snapshot_date = p.snapshot_date AND f.canonical_code = p.canonical_code AND f.rn = p.rf
  LEFT JOIN told q ON q.snapshot_date = p.snapshot_date AND q.canonical_code = p.canonical_code LEFT JOIN known t ON t.snapshot_date = p.snapshot_date AND t.canonical_code = p.canonical_code AND t.rn = q.rg),
ratios AS (SELECT snapshot_date, canonical_code, greatest(dl, df) AS disclosure_date, current_period_type, DATE '1995-01-01' AS price_date, latest_price, eps, bps, roe, equity_ratio, operating_profit / nullif(sales, 0) AS operating_margin,
  {_G('sales', 'sales0')} AS sales_yoy, {_G('operating_profit', 'op0')} AS operating_profit_yoy, {_G('eps', 'eps0')} AS eps_yoy, {_G('fc', 'fc0')} AS forecast_eps_revision,
  CASE WHEN (CASE WHEN fc > 0 THEN fc ELSE fy END) > 0 THEN latest_price / (CASE WHEN fc > 0 THEN fc ELSE fy END) END AS per, CASE WHEN bps > 0 THEN latest_price / bps END AS pbr FROM pieces),
fund AS (SELECT *, ({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in L.RATIOS)}) / 9.0::DOUBLE AS financial_completeness FROM ratios)"""


PIT = f"{FILED}, {GRID}, {_PIT}"


def score_sql(source: str, metrics: dict[str, bool], keep: str, by: str) -> str:
    """CTEs ``clipped`` and ``metric`` over ``source``."""
    clip = ", ".join(f"CASE WHEN count({m}) OVER g >= 10 THEN greatest(least({m}, quantile_cont({m}, 0.975) OVER g), quantile_cont({m}, 0.025) OVER g) ELSE {m} END AS c_{m}" for m in metrics)
    flip = {m: f"c_{m}" if up else f"n_{m}" for m, up in metrics.items()}
    negative = ", ".join(f"-c_{m} AS n_{m}" for m, up in metrics.items() if not up) or "1 AS n_"
    wide = ", ".join(f"{pct(v, by)} AS w_{m}, {pct(v, by + ', sector33_name')} AS s_{m}, count({v}) OVER (PARTITION BY {by}, sector33_name) AS k_{m}" for m, v in flip.items())
    blend = ", ".join(f"((CASE WHEN sector33_name IS NOT NULL AND k_{m} >= 5 THEN s_{m} ELSE w_{m} END) * 0.7 + w_{m} * 0.3) * 100 AS {m}_score" for m in metrics)
    return f"""clipped AS (SELECT *, {clip} FROM {source} WINDOW g AS (PARTITION BY {by})), turned AS (SELECT *, {negative} FROM clipped),
placed AS (SELECT *, {wide} FROM turned), metric AS (SELECT {keep}, {blend} FROM placed)"""


_FACTOR_MEANS = ", ".join(f"coalesce({mean(*[f'{m}_score' for m in names.split()])}, 50) AS {c}" for c, names in R.MEANS.items())
_RAW = {h: " + ".join(f"{c} * {spec[1 + k]}" for c, spec in R.FACTORS.items()) for k, h in enumerate(("6m", "12m"))}
_RANKED = f"""
joined AS (SELECT g.snapshot_date, g.canonical_code, g.model_group, g.sector33_name, g.momentum, g.risk, f.* EXCLUDE (snapshot_date, canonical_code, latest_price) FROM grid g LEFT JOIN fund f ON f.snapshot_date = g.snapshot_date AND f.canonical_code = g.canonical_code),
{score_sql('joined', R.METRICS, 'snapshot_date, canonical_code, momentum, risk, financial_completeness', 'snapshot_date, model_group')},
factored AS (SELECT *, {_FACTOR_MEANS}, coalesce(momentum, 50) AS momentum_score, coalesce(risk, 50) AS risk_score, CASE WHEN canonical_code[-1] = '3' THEN 80.0::DOUBLE ELSE 50.0::DOUBLE END AS qualitative_score,
  CASE WHEN canonical_code[-1] = '3' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS qualitative_confidence, 0.4::DOUBLE + 0.6::DOUBLE * coalesce(financial_completeness, 0) AS confidence FROM metric),
final AS (SELECT *, {', '.join(f"greatest(least(50.0::DOUBLE + confidence * (({_RAW[h]}) - 50.0::DOUBLE) + {R.QUALITATIVE[h]}::DOUBLE * qualitative_confidence * (qualitative_score - 50), 100), 0) AS score_{h}" for h in ('6m', '12m'))} FROM factored)"""
RANKED = f"{PIT}, {_RANKED}"
_NAMES = [*R.FACTORS, "qualitative_score", "qualitative_confidence", "confidence", "score_6m", "score_12m"]
_RANKS = f"SELECT snapshot_date, canonical_code, {', '.join(f'{r(c)} AS {c}' for c in _NAMES)} FROM final"
_WEIGHTS = ", ".join(f"(canonical_code, {spec[2]}::DOUBLE * ({c} - 50), {k})" for k, (c, spec) in enumerate(R.FACTORS.items()))



def ranked_on(grid: str, code: str, opinion: str = "false") -> str:
    """CTEs up to ``final`` over another ``grid`` (a query), whose filings have another code, of customers' keys
    ``o_custkey``."""
    filed = FILED.replace("CASE WHEN o_custkey < 1000 THEN lpad(CAST(o_custkey AS VARCHAR), 4, '0') ELSE CAST(o_custkey AS VARCHAR) END || '0' AS code", f"{code} AS code")
    rest = f"{_PIT}, {_RANKED}".replace("canonical_code[-1] = '3'", opinion).replace("grid g", "asked g")
    return f"{filed}, asked AS ({grid}), {rest}"


SQL = {
    "filings": f"WITH {FILED} SELECT {_KEY}, document_type, disclosure_time, disclosure_number, {', '.join(f'{r(c)} AS {c}' for c in _AMOUNTS)} FROM merged",
    "fundamentals_pit": f"WITH {PIT} SELECT snapshot_date, canonical_code, disclosure_date, current_period_type, price_date, {', '.join(f'{r(c)} AS {c}' for c in ['latest_price', 'eps', 'bps', *L.RATIOS, 'financial_completeness'])} FROM fund",
    "metric_scores": f"""WITH base AS (SELECT c_custkey, c_mktsegment AS model_group, CAST(c_nationkey AS VARCHAR) AS sector33_name, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS per, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal % 97 END AS roe FROM customer),
      {score_sql('base', {'per': False, 'roe': True}, 'c_custkey', 'model_group')} SELECT c_custkey, {r('per_score')} AS per_score, {r('roe_score')} AS roe_score FROM metric""",
    "rule_rank": f"WITH {RANKED} {_RANKS}",
    "rank_places": f"WITH {RANKED}, settled AS ({_RANKS}) SELECT snapshot_date, canonical_code, rank() OVER (PARTITION BY snapshot_date ORDER BY score_6m DESC) AS rank_6m, rank() OVER (PARTITION BY snapshot_date ORDER BY score_12m DESC) AS rank_12m FROM settled",
    "reasons_topk": f"""WITH {RANKED}, settled AS (SELECT canonical_code, {', '.join(f"{r(c)} + 0.0137::DOUBLE AS {c}" for c in [*R.FACTORS, 'qualitative_score'])}, qualitative_confidence FROM final WHERE snapshot_date = DATE '{DATES[-1]}'),
      parts AS (SELECT canonical_code, unnest([{', '.join(f"{{'f': '{spec[0]}', 's': {c}, 'w': {spec[2]}::DOUBLE * ({c} - 50), 'k': {k}}}" for k, (c, spec) in enumerate(R.FACTORS.items()))},
        {{'f': 'Qualitative', 's': qualitative_score, 'w': {R.QUALITATIVE['12m']}::DOUBLE * qualitative_confidence * (qualitative_score - 50), 'k': {len(R.FACTORS)}}}]) AS p FROM settled),
      listed AS (SELECT canonical_code, p.f || '=' || CAST(round(round_even(p.s, 1) * 10) AS BIGINT) || '/' || CAST(round(round_even(p.w, 1) * 10) AS BIGINT) AS t, p.w > 0 AS up, p.w < 0 AS down,
        row_number() OVER (PARTITION BY canonical_code, p.w > 0, p.w < 0 ORDER BY -abs(round_even(p.w, 1)), p.k) AS i FROM parts)
      SELECT canonical_code, coalesce(string_agg(t, ',' ORDER BY i) FILTER (WHERE up AND i <= 3), '') AS positive, coalesce(string_agg(t, ',' ORDER BY i) FILTER (WHERE down AND i <= 3), '') AS negative FROM listed GROUP BY 1""",
}
