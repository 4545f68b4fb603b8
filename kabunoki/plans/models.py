"""Queries on features and labels of nations' bars, with their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import settle
from kabunoki.operators import filings as L
from kabunoki.operators import learning as M
from kabunoki.operators import prices as P
from kabunoki.operators import ranking as R
from kabunoki.plans.companies import ranked_on
from kabunoki.plans.market import ROWS, bars, longs, pct, price_rows, r, rounded
from kabunoki.session import load

_F = M.PRICE_FEATURES


def labelled(s: SparkSession, d: str) -> DataFrame:
    return price_rows(s, d).where("forward_return_6m IS NOT NULL")


def _percentiles(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.percentile_features(labelled(s, d), _F).select("evaluation_date", "canonical_code", *[f"{c}_pct" for c in _F]))


def _settled(s: SparkSession, d: str) -> DataFrame:
    # Values are settled before they are ranked: the last bit of a sum must not decide between equals.
    x = labelled(s, d)
    return x.select("evaluation_date", "canonical_code", settle(F.col("momentum_score")).alias("momentum_score"), settle(F.col("forward_return_6m")).alias("forward_return_6m"), settle(F.col("volatility_60d")).alias("volatility_60d"), settle(F.col("return_1m")).alias("return_1m"))


def _monthly(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.monthly_evaluation(_settled(s, d), "momentum_score", "forward_return_6m"))


def _evaluation(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.evaluate_ranking(_settled(s, d), "momentum_score", "forward_return_6m"))


def _target(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.excess_target(labelled(s, d), "forward_return_6m").select("evaluation_date", "canonical_code", "target_excess"))


def _gram(s: SparkSession, d: str) -> DataFrame:
    f = M.excess_target(M.percentile_features(labelled(s, d), _F[:4]), "forward_return_6m")
    return rounded(M.gram(f, [f"{c}_pct" for c in _F[:4]], "target_excess"), 5)


def _ridge(s: SparkSession, d: str) -> DataFrame:
    f = M.excess_target(M.percentile_features(labelled(s, d), _F), "forward_return_6m")
    model = M.fit_ridge(f, [f"{c}_pct" for c in _F], "target_excess", 10.0)
    return rounded(f.select("evaluation_date", "canonical_code", model.predict().alias("prediction")))


def _train(s: SparkSession, d: str) -> DataFrame:
    from kabunoki.plans.companies import filings

    # Nations have no filings of their own: customers of the same number stand in for them.
    f = filings(s, d).withColumn("code", F.concat(F.lit("N"), (F.col("code").cast("long") % 25).cast("string")))
    who = load(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_code"), F.col("n_name").alias("company_name"), F.col("n_regionkey").cast("string").alias("sector33_name"), F.lit("general").alias("model_group"))
    out = M.training_set(bars(s, d), f, who)
    return longs(rounded(out.drop("cutoff_at")))


QUERIES = {
    "pct_features": _percentiles,
    "excess_target": _target,
    "monthly_ic": _monthly,
    "ranking_evaluation": _evaluation,
    "ridge_gram": _gram,
    "ridge_predict": _ridge,
    "training_set": _train,
    "eda_summary": lambda s, d: rounded(M.summary(load(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax")), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "spearman_matrix": lambda s, d: rounded(M.spearman_matrix(load(s, d, "part").select("p_brand", "p_size", "p_retailprice", F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("p_partkey")), ["p_size", "p_retailprice", "p_partkey"], "p_brand")),
}

P_ = lambda c: r("CASE WHEN r.average_turnover_20d >= 0 THEN ln(1 + r.average_turnover_20d) END" if c == "log_average_turnover_20d" else f"r.{c}")
_LABELLED = f"{ROWS}, labelled_ AS (SELECT *, CASE WHEN average_turnover_20d >= 0 THEN ln(1 + average_turnover_20d) END AS log_average_turnover_20d FROM rows_ WHERE forward_return_6m IS NOT NULL)"
_PCT = lambda fs: ", ".join(f"coalesce({pct(c, 'evaluation_date')}, 0.5) AS {c}_pct" for c in fs)
_PCTS = [f"{c}_pct" for c in _F]
_EXCESS = "forward_return_6m - median(forward_return_6m) OVER (PARTITION BY evaluation_date) AS target_excess"
_Q = [f"{c}_pct" for c in _F[:4]] + ["target_excess"]
_MONTHLY = f"""{_LABELLED},
e AS (SELECT evaluation_date, canonical_code, {r('momentum_score')} AS p, {r('forward_return_6m')} AS a FROM labelled_),
e1 AS (SELECT *, count(*) OVER (PARTITION BY evaluation_date) AS n FROM e WHERE p IS NOT NULL AND a IS NOT NULL),
e2 AS (SELECT *, greatest(5, ceil(n * 0.1)) AS k, {pct('p', 'evaluation_date')} AS rp, {pct('a', 'evaluation_date')} AS ra, row_number() OVER (PARTITION BY evaluation_date ORDER BY p DESC, canonical_code) AS i FROM e1 WHERE n >= 10),
e3 AS (SELECT evaluation_date, count(*) AS rows, CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(ra) > 0 THEN covar_pop(rp, ra) / (stddev_pop(rp) * stddev_pop(ra)) END AS ic, avg(a) FILTER (WHERE i <= k) AS top_return, avg(a) AS universe_return,
  avg(a) FILTER (WHERE i > n - k) AS bottom_return, list(canonical_code) FILTER (WHERE i <= k) AS codes FROM e2 GROUP BY 1),
monthly AS (SELECT *, top_return - universe_return AS top_excess, top_return - bottom_return AS long_short, CASE WHEN lag(codes) OVER (ORDER BY evaluation_date) IS NOT NULL THEN 1 - len(list_intersect(codes, lag(codes) OVER (ORDER BY evaluation_date))) / len(codes)::DOUBLE END AS turnover FROM e3)"""
_MEASURES = "ic top_return universe_return top_excess bottom_return long_short turnover".split()

_TRAIN_GRID = """SELECT r.evaluation_date AS snapshot_date, r.canonical_code, CASE WHEN r.valuation_price > 0 THEN r.valuation_price END AS latest_price, r.momentum_score AS momentum, r.risk_score AS risk, 'general' AS model_group, CAST(n_regionkey AS VARCHAR) AS sector33_name
  FROM rows_ r JOIN nation ON r.canonical_code = 'N' || n_nationkey"""
_KNOWN = [c for c in M.FEATURES if c not in M.PRICE_FEATURES]
_TRAINING = f"""WITH {ROWS}, {ranked_on(_TRAIN_GRID, "'N' || (o_custkey * 10 % 25)")}
  SELECT r.evaluation_date, r.canonical_code, 'general' AS model_group, CAST(n_regionkey AS VARCHAR) AS sector33_name, f.disclosure_date, r.trade_date AS price_date,
    {', '.join(f"{P_(c)} AS {c}" for c in M.PRICE_FEATURES)}, {', '.join(f"{r(f'f.{c}')} AS {c}" for c in _KNOWN)}, {r('x.confidence')} AS rule_confidence, {r('x.score_12m')} AS rule_score_12m, {r('x.score_6m')} AS rule_score_6m,
    r.label_start_date, r.label_end_date_6m, {r('r.forward_return_6m')} AS forward_return_6m, r.label_end_date_12m, {r('r.forward_return_12m')} AS forward_return_12m, CAST(NULL AS VARCHAR) AS universe_as_of, true AS survivor_bias_flag,
    '{P.CLEANING_VERSION}' AS price_cleaning_version, '{L.FUNDAMENTAL_VERSION}' AS fundamental_feature_version, '{R.RANKING_VERSION}' AS rule_ranking_version, '{M.DATASET_VERSION}' AS dataset_version
  FROM rows_ r JOIN nation ON r.canonical_code = 'N' || n_nationkey LEFT JOIN fund f ON f.snapshot_date = r.evaluation_date AND f.canonical_code = r.canonical_code LEFT JOIN final x ON x.snapshot_date = r.evaluation_date AND x.canonical_code = r.canonical_code"""


def _rho(x: str, y: str) -> str:
    return f"""SELECT p_brand, '{x}' AS x, '{y}' AS y, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN {r('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))')} END AS rho
      FROM (SELECT p_brand, {pct(x, 'p_brand')} AS rx, {pct(y, 'p_brand')} AS ry FROM p WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1"""


SQL = {
    "training_set": _TRAINING,
    "pct_features": f"WITH {_LABELLED}, q AS (SELECT evaluation_date, canonical_code, {_PCT(_F)} FROM labelled_) SELECT evaluation_date, canonical_code, {', '.join(f'{r(c)} AS {c}' for c in _PCTS)} FROM q",
    "excess_target": f"WITH {_LABELLED}, q AS (SELECT evaluation_date, canonical_code, {_EXCESS} FROM labelled_) SELECT evaluation_date, canonical_code, {r('target_excess')} AS target_excess FROM q",
    "monthly_ic": f"WITH {_MONTHLY} SELECT evaluation_date, rows, {', '.join(f'{r(c)} AS {c}' for c in _MEASURES)} FROM monthly",
    "ranking_evaluation": f"""WITH {_MONTHLY} SELECT (SELECT count(*) FROM e1) AS rows, count(*) AS months, {r('avg(ic)')} AS mean_spearman_ic, {r('median(ic)')} AS median_spearman_ic, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ic_rate,
      {r('avg(top_return)')} AS top_decile_return, {r('avg(universe_return)')} AS universe_return, {r('avg(top_excess)')} AS top_decile_excess, {r('avg(CASE WHEN top_excess > 0 THEN 1.0 ELSE 0.0 END)')} AS top_decile_excess_win_rate,
      {r('avg(long_short)')} AS long_short_spread, {r('avg(turnover)')} AS mean_top_decile_turnover FROM monthly""",
    "ridge_gram": f"WITH {_LABELLED}, q AS (SELECT {_PCT(_F[:4])}, {_EXCESS} FROM labelled_) SELECT count(*) AS n, {', '.join(f'{r(f'sum({c})', 5)} AS s_{i}' for i, c in enumerate(_Q))}, {', '.join(f'{r(f'sum({_Q[i]} * {_Q[j]})', 5)} AS q_{i}_{j}' for i in range(5) for j in range(i, 5))} FROM q",
    "eda_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count({x}) AS n, {r(f'avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate, {r(f'median({x})')} AS median, {r(f'quantile_cont({x}, 0.05)')} AS p05, {r(f'quantile_cont({x}, 0.95)')} AS p95 FROM lineitem"
        for c, x in [(c, c) for c in ("l_quantity", "l_extendedprice", "l_discount")] + [("l_tax", "(CASE WHEN l_linenumber <> 3 THEN l_tax END)")]
    ),
    "spearman_matrix": "WITH p AS (SELECT p_brand, p_size, p_retailprice, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS p_partkey FROM part) " + " UNION ALL ".join(_rho(x, y) for x, y in (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey"))),
}
