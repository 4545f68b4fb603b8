"""Every query with an equivalent in SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import pytest

from kabunoki.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_more_rows_make_more_responses_not_longer_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kabunoki.plans import control
    from kabunoki.sources import saved

    seen, filings = [], saved.filings
    monkeypatch.setattr(saved, "filings", lambda r: seen.append(r) or filings(r))
    monkeypatch.setattr(control, "load", lambda *_: spark.range(60_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 99).alias("o_custkey"), F.lit(7.0).alias("o_totalprice")))
    assert catalog.QUERIES["saved_filings"](spark, DATA).select("disclosure_number").distinct().count() == 60_000
    sizes = [r.n for r in seen[0].select(F.json_array_length(F.get_json_object("content", "$.data")).alias("n")).collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 1_000


# What has no equivalent in SQL.


def test_visible_text_of_pages(spark):
    from kabunoki.sources import web

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r.visible_text for r in catalog.QUERIES["visible_text"](spark, DATA).collect()}
    assert got == {k: web.visible(h) for k, h in pages.items()} and any("<" not in t and t for t in got.values())


def test_predictions_are_those_of_the_closed_form(spark):
    import numpy as np

    from kabunoki.operators import learning as M
    from kabunoki.plans import models

    at = DATA.replace("sf0.001", "sf0.01")
    frame = M.excess_target(M.percentile_features(models.labelled(spark, at), M.PRICE_FEATURES), "forward_return_6m")
    names = [f"{c}_pct" for c in M.PRICE_FEATURES]
    p = frame.select("evaluation_date", "canonical_code", *names, "target_excess").toPandas()
    x, y = p[names].to_numpy(), p["target_excess"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(len(names)), z.T @ (y - y.mean()))
    want = {(d, c): v for d, c, v in zip(p["evaluation_date"], p["canonical_code"], y.mean() + z @ w)}
    got = {(r.evaluation_date, r.canonical_code): r.prediction for r in catalog.QUERIES["ridge_predict"](spark, at).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_training_finds_the_feature_that_decides(spark):
    got = {r.scored_by: r for r in catalog.QUERIES["model_training"](spark, DATA.replace("sf0.001", "sf0.01")).collect()}
    assert set(got) == {"model", "rule"} and got["model"].months >= 8 and got["model"].mean_spearman_ic > 0.7 > got["rule"].mean_spearman_ic


def test_all_others_are_tested_above():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"visible_text", "ridge_predict", "model_training"}
