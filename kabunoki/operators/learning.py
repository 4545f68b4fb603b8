"""Learning to rank: point-in-time training sets, percentile features, ridge regression by its Gram matrix, purged
temporal splits, and evaluation by month.

Everything that touches rows is a DataFrame; the driver holds a Gram matrix of features by features, a list of evaluation
dates, and models.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.functions.kit import finite, percentile_rank, rank_desc, spearman, tokyo_to_utc
from kabunoki.operators import filings as L
from kabunoki.operators import order
from kabunoki.operators import prices as P
from kabunoki.operators import ranking as R

DATASET_VERSION, MODEL_VERSION = "monthly_1", "ridge_1"
PRICE_FEATURES = "return_1m return_3m return_6m return_12m momentum_12_1 high_52w_distance max_drawdown_252d volatility_20d volatility_60d downside_volatility_60d log_average_turnover_20d".split()
FEATURES = PRICE_FEATURES + "pbr per equity_ratio roe operating_margin eps_yoy sales_yoy operating_profit_yoy forecast_eps_revision financial_completeness".split()
HORIZONS = {"6m": 6, "12m": 12}
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
LEAST_IN_MONTH = 10


def training_set(bars: DataFrame, filings: DataFrame, securities: DataFrame, period: tuple[str | None, str | None] = (None, None), universe_as_of: str | None = None, version: str = DATASET_VERSION) -> DataFrame:
    """One row for each security and month: what was known on that day, rule scores, and forward labels."""
    cleaned = P.clean(bars)
    rows = P.price_rows(cleaned, P.month_calendar(cleaned, filings, period))
    known = L.fundamentals(filings, rows.select("snapshot_date", "canonical_code", "price_date", "latest_close"))
    ranks = R.investment_ranks(securities, rows, known)
    wanted = [c for c in FEATURES if c not in PRICE_FEATURES]
    scores = ranks.select("snapshot_date", "canonical_code", *[F.col(f"score_{h}").alias(f"rule_score_{h}") for h in HORIZONS], F.col("confidence").alias("rule_confidence"))
    out = rows.join(known.select("snapshot_date", "canonical_code", "disclosure_date", *wanted), ["snapshot_date", "canonical_code"], "left").join(scores, ["snapshot_date", "canonical_code"], "left")
    out = out.join(securities.select("canonical_code", "sector33_name", "model_group"), "canonical_code", "left")
    return out.select(
        "evaluation_date", "canonical_code", tokyo_to_utc(F.col("evaluation_date"), "23:59:59").alias("cutoff_at"), *"model_group sector33_name disclosure_date price_date".split(), *FEATURES,
        *"rule_confidence rule_score_12m rule_score_6m label_start_date".split(), *[c for h in HORIZONS for c in (f"label_end_date_{h}", f"forward_return_{h}")],
        F.lit(universe_as_of).alias("universe_as_of"), F.lit(True).alias("survivor_bias_flag"), F.lit(P.CLEANING_VERSION).alias("price_cleaning_version"),
        F.lit(L.FUNDAMENTAL_VERSION).alias("fundamental_feature_version"), F.lit(R.RANKING_VERSION).alias("rule_ranking_version"), F.lit(version).alias("dataset_version"),
    )


def percentile_features(frame: DataFrame, features: list[str], date: str = "evaluation_date") -> DataFrame:
    """``<feature>_pct``: each month's percentile ranks, 0.5 where the feature is missing."""
    return frame.withColumns({f"{c}_pct": F.coalesce(percentile_rank(finite(F.col(c).cast("double")), date), F.lit(0.5)) for c in features})


def excess_target(frame: DataFrame, label: str, date: str = "evaluation_date") -> DataFrame:
    return frame.withColumn("target_excess", F.col(label) - F.median(label).over(W.partitionBy(date)))


def gram(frame: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One row: n, and sums s_i, q_i_j of the columns (and target, the last) and their products, in one aggregation."""
    every = [F.col(c).cast("double") for c in (*columns, target)]
    m = len(every)
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(every)]
    products = [F.sum(every[i] * every[j]).alias(f"q_{i}_{j}") for i in range(m) for j in range(i, m)]
    return frame.agg(F.count(F.lit(1)).alias("n"), *sums, *products)


@dataclass
class Ridge:
    features: list[str]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    alpha: float

    def predict(self) -> Column:
        """The prediction, an expression over the feature columns."""
        terms = (((F.col(c) - F.lit(m)) / F.lit(s)) * F.lit(w) for c, m, s, w in zip(self.features, self.means, self.scales, self.coefficients))
        return sum(terms, F.lit(self.intercept))

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Ridge:
        return Ridge(**json.loads(text))


def solve_ridge(g: dict, features: list[str], alpha: float) -> Ridge:
    """The model of standardised features (population deviation) from a Gram row."""
    n, m = g["n"], len(features)
    if not n:
        raise ValueError("no rows to train on: the purged training period is empty")
    mean = np.array([g[f"s_{i}"] for i in range(m + 1)]) / n
    q = np.zeros((m + 1, m + 1))
    for i in range(m + 1):
        for j in range(i, m + 1):
            q[i, j] = q[j, i] = g[f"q_{i}_{j}"]
    centred = q - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred)[:m] / n, 0))
    scale[scale < 1e-12] = 1.0
    a = centred[:m, :m] / np.outer(scale, scale) + alpha * np.eye(m)
    b = centred[:m, m] / scale
    w = np.linalg.solve(a, b) if np.linalg.matrix_rank(a) == m else np.linalg.pinv(a) @ b
    return Ridge(list(features), mean[:m].tolist(), scale.tolist(), w.tolist(), float(mean[m]), float(alpha))


def fit_ridge(frame: DataFrame, features: list[str], target: str, alpha: float) -> Ridge:
    return solve_ridge(gram(frame, features, target).first().asDict(), features, alpha)


def monthly_evaluation(frame: DataFrame, prediction: str, actual: str, date: str = "evaluation_date", code: str = "canonical_code") -> DataFrame:
    """Per month of at least ten complete rows: rank correlation, returns of the top and bottom tenths (five at least)
    and of all, and the turnover of the top since the previous such month."""
    d = frame.select(date, code, F.col(prediction).alias("p"), F.col(actual).alias("a")).dropna()
    w = W.partitionBy(date)
    d = d.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= LEAST_IN_MONTH)
    d = d.withColumns(
        {
            "k": F.greatest(F.lit(5), F.ceil(F.col("n") * 0.1)), "rp": percentile_rank(F.col("p"), date), "ra": percentile_rank(F.col("a"), date),
            "first": F.row_number().over(w.orderBy(F.desc("p"), F.col(code))),
        }
    )
    top, bottom = F.col("first") <= F.col("k"), F.col("first") > F.col("n") - F.col("k")
    m = d.groupBy(date).agg(
        F.count(F.lit(1)).alias("rows"), spearman(F.col("rp"), F.col("ra")).alias("ic"), F.avg(F.when(top, F.col("a"))).alias("top_return"), F.avg("a").alias("universe_return"),
        F.avg(F.when(bottom, F.col("a"))).alias("bottom_return"), F.collect_set(F.when(top, F.col(code))).alias("top_codes"),
    )
    # One row per month: the only window without a partition, over some hundreds of rows.
    before = F.lag("top_codes").over(W.orderBy(date))
    return m.withColumn("turnover", F.when(before.isNotNull(), 1 - F.size(F.array_intersect("top_codes", before)) / F.size("top_codes"))).select(
        date, "rows", "ic", "top_return", "universe_return", (F.col("top_return") - F.col("universe_return")).alias("top_excess"), "bottom_return", (F.col("top_return") - F.col("bottom_return")).alias("long_short"), "turnover"
    )


def evaluate_ranking(frame: DataFrame, prediction: str, actual: str) -> DataFrame:
    """One row of measures over the months; with no month of enough rows, 0 months and nulls."""
    m = monthly_evaluation(frame, prediction, actual)
    share = lambda c: F.avg(F.coalesce((c > 0).cast("double"), F.lit(0.0)))
    measures = m.agg(
        F.count(F.lit(1)).alias("months"), F.avg("ic").alias("mean_spearman_ic"), F.median("ic").alias("median_spearman_ic"), share(F.col("ic")).alias("positive_ic_rate"),
        F.avg("top_return").alias("top_decile_return"), F.avg("universe_return").alias("universe_return"), F.avg("top_excess").alias("top_decile_excess"),
        share(F.col("top_excess")).alias("top_decile_excess_win_rate"), F.avg("long_short").alias("long_short_spread"), F.avg("turnover").alias("mean_top_decile_turnover"),
    )
    rows = frame.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull()).agg(F.count(F.lit(1)).alias("rows"))
    return rows.crossJoin(measures)


def temporal_split(frame: DataFrame, label_end: str, date: str = "evaluation_date") -> tuple[DataFrame, dict]:
    """``frame`` with flags in_train, in_validation, in_final and in_test, and where the periods begin. A label must end
    before the period after it begins."""
    pairs = frame.where(F.col(date).isNotNull()).groupBy(date).agg(F.min(label_end).alias("e")).orderBy(date).collect()
    dates = [r[date] for r in pairs]
    if len(dates) < 24:
        raise ValueError("a split needs at least 24 labelled months")
    test = dates[max(2, len(dates) * 85 // 100)]
    eligible = [r[date] for r in pairs if r[date] < test and r["e"] is not None and r["e"] < test]
    months = max(12, -(-len(dates) * 15 // 100))
    if len(eligible) <= months:
        raise ValueError("not enough months without overlap for validation")
    validation = eligible[-months]
    d, e = F.col(date), F.col(label_end)
    return frame.withColumns(
        {
            "in_train": (d < F.lit(validation)) & (e < F.lit(validation)), "in_validation": (d >= F.lit(validation)) & (d < F.lit(test)) & (e < F.lit(test)),
            "in_final": (d < F.lit(test)) & (e < F.lit(test)), "in_test": d >= F.lit(test),
        }
    ), {"validation_start": validation, "test_start": test}


def train(dataset: DataFrame, horizon: str, alphas: tuple[float, ...] = ALPHAS, features: list[str] = FEATURES) -> tuple[dict, DataFrame, Ridge]:
    """(what was chosen and measured, predictions for the test months and the latest one, the deployed model)."""
    label, end, baseline = f"forward_return_{horizon}", f"label_end_date_{horizon}", f"rule_score_{horizon}"
    names = [f"{c}_pct" for c in features]
    frame = excess_target(percentile_features(dataset.where(F.col(label).isNotNull() & F.col(end).isNotNull()), features), label)
    frame, split = temporal_split(frame, end)
    frame = frame.persist()
    try:
        first = gram(frame.where("in_train"), names, "target_excess").first().asDict()
        seen = frame.where("in_validation")
        score = lambda model: evaluate_ranking(seen.withColumn("prediction", model.predict()), "prediction", label).first().asDict()
        candidates = [dict(alpha=a, metrics=score(solve_ridge(first, names, a))) for a in alphas]
        best = max(candidates, key=lambda c: (c["metrics"]["mean_spearman_ic"] or -1e9, c["metrics"]["top_decile_excess"] or -1e9))["alpha"]
        final = fit_ridge(frame.where("in_final"), names, "target_excess", best)
        deployed = fit_ridge(frame, names, "target_excess", best)
        test = frame.where("in_test").withColumn("prediction", final.predict())
        report = {
            "horizon": horizon, "alpha": best, "candidates": candidates, "split": split, "test": evaluate_ranking(test, "prediction", label).first().asDict(),
            "baseline": evaluate_ranking(test, baseline, label).first().asDict(), "evaluation_model": asdict(final), "model_version": MODEL_VERSION,
        }
        last = dataset.agg(F.max("evaluation_date").alias("last"))
        latest = dataset.join(F.broadcast(last), dataset["evaluation_date"] == last["last"]).drop("last")  # one row
        latest = percentile_features(latest, features).withColumn("prediction", deployed.predict())
        pick = ["evaluation_date", "canonical_code", F.col(label).alias("actual_return"), F.col(baseline).alias("baseline_score"), "prediction"]
        both = test.select(*pick, F.lit("test").alias("split")).unionByName(latest.select(*pick, F.lit("latest").alias("split")))
        by = ("split", "evaluation_date")
        return report, both.withColumns({"predicted_rank": rank_desc(F.col("prediction"), *by), "actual_rank": rank_desc(F.col("actual_return"), *by)}), deployed
    finally:
        frame.unpersist()


def infer(inputs: DataFrame, model: Ridge, horizon: str, date: str = "snapshot_date", run: str | None = None) -> DataFrame:
    """Scores and ranks of current rows by a stored model."""
    raw = [c.removesuffix("_pct") for c in model.features]
    if "log_average_turnover_20d" in raw and "log_average_turnover_20d" not in inputs.columns:
        inputs = inputs.withColumn("log_average_turnover_20d", F.when(F.col("average_turnover_20d") >= 0, F.log1p("average_turnover_20d")))
    out = percentile_features(inputs, raw, date).withColumn("model_score", model.predict())
    out = out.withColumns({"model_rank": rank_desc(F.col("model_score"), date), "horizon": F.lit(horizon), "model_version": F.lit(MODEL_VERSION), "model_run": F.lit(run)})
    return out.select(*inputs.columns, "model_score", "model_rank", "horizon", "model_version", "model_run").orderBy("model_rank", "canonical_code")


def summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, missing_rate, median, p05, p95) of numeric columns, from an unpivot. The quantiles are exact, and found
    in pieces: no task holds the values of a column."""
    long = frame.select(*[(finite(F.col(c).cast("double")) + 0.0).alias(c) for c in columns]).unpivot([], columns, "metric", "value")
    groups = order.cut(long, ["metric"], "value", 0)
    found = order.quantiles(long, ["metric"], "value", (0.05, 0.5, 0.95), groups)
    rows = []
    for g, c in groups.items():
        n = sum(c.counts)
        low, middle, high = (x[0] for x in found[g]) if n else (None, None, None)
        rows.append((*g, n, c.nulls / (n + c.nulls), middle, low, high))
    return frame.sparkSession.createDataFrame(rows, "metric string, n long, missing_rate double, median double, p05 double, p95 double")


def spearman_matrix(frame: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, rho): rank correlations of all pairs of columns within each ``by``, over rows where neither is null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    f, out = frame, []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        f = f.withColumns({f"_x{k}": percentile_rank(F.when(both, F.col(a).cast("double")), by), f"_y{k}": percentile_rank(F.when(both, F.col(b).cast("double")), by)})
        ok = F.col(f"_x{k}").isNotNull()
        out.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), spearman(F.when(ok, F.col(f"_x{k}")), F.when(ok, F.col(f"_y{k}"))).alias("rho")))
    return f.groupBy(by).agg(F.array(*out).alias("m")).select(by, F.explode("m").alias("m")).select(by, "m.x", "m.y", "m.rho")
