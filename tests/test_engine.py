"""Operators on hand-made frames, with exact expectations, and invariance to the order of rows."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kabunoki.functions import kit
from kabunoki.operators import documents as D
from kabunoki.operators import filings as L
from kabunoki.operators import learning as M
from kabunoki.operators import operations as O
from kabunoki.operators import order
from kabunoki.operators import prices as P
from kabunoki.operators import ranking as R
from kabunoki.sources import web
from kabunoki.streaming.incremental import VersionedTable, ingest

BAR = "trade_date date, canonical_code string, source string, open double, high double, low double, close double, adjusted_close double, volume double"


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def bar(when: str, **other) -> tuple:
    row = dict(zip("open high low close adjusted_close volume".split(), (100.0, 105.0, 95.0, 102.0, 100.0, 1000.0))) | other
    return (day(when), "1000", "q", *row.values())


def test_cleaning_finds_four_rules_and_excludes_three(spark):
    rows = [
        bar("2024-01-01", high=101.0), bar("2024-01-02", adjusted_close=-10.0), bar("2024-01-03", adjusted_close=5000.0),
        bar("2024-01-04", volume=0.0, **dict.fromkeys("adjusted_close close open low high".split(), 1e10)),
    ]
    raw = spark.createDataFrame(rows, BAR)
    cleaned = P.clean(raw)
    events = P.quality_events(cleaned)
    assert {r.reason_code for r in events.collect()} == set("ohlc_boundary_error adjustment_ratio_outlier adjusted_close_nonpositive zero_volume_scale_outlier".split())
    total = {r.reason_code: r for r in P.quality_summary(events).collect()}["all"]
    assert (total.affected_rows, total.excluded_model_rows) == (4, 3)
    first = cleaned.orderBy("trade_date").first()
    assert (first.clean_high, first.high, first.quality_status) == (102.0, 101.0, "corrected")


def test_cleaning_takes_nan_infinity_and_null_as_missing(spark):
    rows = [bar("2024-01-01", close=float("nan")), bar("2024-01-02", adjusted_close=float("inf")), bar("2024-01-03", open=None), bar("2024-01-04", volume=-1.0)]
    got = {r.trade_date.day: r for r in P.clean(spark.createDataFrame(rows, BAR)).collect()}
    assert got[1].return_price is None and got[1].clean_close is None
    assert got[2].return_price is None and got[2].quality_status == "excluded"
    assert got[3].clean_open is None and got[3].return_price == 100.0
    assert got[4].clean_volume is None and got[4].quality_status == "corrected"


def series(spark, prices, start="2024-01-01", bad=()):
    days = pd.bdate_range(start, periods=len(prices))
    rows = [bar(d.date().isoformat(), adjusted_close=-1.0 if i in bad else float(p), close=float(p), high=p + 9.0, low=p - 9.0, open=float(p)) for i, (d, p) in enumerate(zip(days, map(float, prices)))]
    return spark.createDataFrame(rows, BAR)


def test_price_features_match_numpy_and_ignore_row_order(spark):
    rng = np.random.default_rng(0)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    raw = series(spark, x)
    f = P.price_features(P.clean(raw)).first()
    g = P.price_features(P.clean(raw.orderBy(F.rand(1)).repartition(7))).first()
    assert f == g
    r = np.diff(x) / x[:-1]
    last = x[-252:]
    assert f.return_12m == pytest.approx(x[-1] / x[-253] - 1)
    assert f.momentum_12_1 == pytest.approx(x[-22] / x[-253] - 1)
    assert f.volatility_20d == pytest.approx(r[-20:].std(ddof=1) * math.sqrt(252))
    d = r[-60:]
    assert f.downside_volatility_60d == pytest.approx(d[d < 0].std(ddof=1) * math.sqrt(252))
    assert f.max_drawdown_252d == pytest.approx((last / np.maximum.accumulate(last) - 1).min())
    assert f.high_52w_distance == pytest.approx(x[-1] / last.max() - 1)


def test_features_do_not_cross_an_invalid_bar(spark):
    f = P.price_features(P.clean(series(spark, np.linspace(100, 200, 391), bad={260}))).first()
    assert f.return_12m is None and f.return_6m > 0


def test_segments_break_at_long_gaps_only(spark):
    rows = [bar("2024-01-01"), bar("2024-01-11"), bar("2024-01-22"), bar("2024-01-23")]
    got = [r.segment for r in P.segments(P.clean(spark.createDataFrame(rows, BAR))).orderBy("trade_date").collect()]
    assert got == [0, 0, 1, 1]


def test_forward_label_and_its_segment(spark):
    rows = [("A", day("2025-01-31"), True, 90.0, 0), ("A", day("2025-02-03"), True, 100.0, 0), ("A", day("2025-07-31"), True, 120.0, 0), ("B", day("2025-02-03"), True, 100.0, 0), ("B", day("2025-07-31"), True, 120.0, 1)]
    seg = spark.createDataFrame(rows, "canonical_code string, trade_date date, valid boolean, return_price double, segment long")
    grid = spark.createDataFrame([("A", day("2025-01-31")), ("B", day("2025-01-31"))], "canonical_code string, evaluation_date date")
    got = {r.canonical_code: r for r in P.forward_labels(seg, grid, 6).collect()}
    assert got["A"].label_start_date == day("2025-02-03") and got["A"].forward_return_6m == pytest.approx(0.2)
    assert got["B"].label_start_date == day("2025-02-03") and got["B"].forward_return_6m is None


def test_percentile_rank_of_ties_and_nulls(spark):
    f = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 4.0, None, 3.0)], "v double")
    got = {r.v: r.p for r in f.select("v", kit.percentile_rank(F.col("v"), F.lit(1)).alias("p")).collect()}
    assert got == {1.0: 0.2, 2.0: 0.5, 4.0: 1.0, None: None, 3.0: 0.8}


FILING = "code string, disclosure_date date, disclosure_time string, disclosure_number string, document_type string, current_period_type string, current_period_end date, current_fiscal_year_end date, sales double, operating_profit double, eps double, bps double, roe double, equity_ratio double, forecast_eps double"


def filing(when, time, number, kind, end, year, sales=None, op=None, eps=None, bps=None, roe=None, eq=None, fc=None):
    return ("10000", day(when), time, number, "d", kind, day(end), day(year), sales, op, eps, bps, roe, eq, fc)


def price(spark, close=800.0, when="2026-01-01"):
    return spark.createDataFrame([(day(when), "1000", day(when), close)], "snapshot_date date, canonical_code string, price_date date, latest_close double")


def test_fundamentals(spark):
    rows = [filing("2024-05-10", "15:00", "1", "FY", "2024-03-31", "2024-03-31", 100.0, 10.0, 16.0), filing("2025-05-10", "15:00", "2", "FY", "2025-03-31", "2025-03-31", 120.0, 15.0, 20.0, 160.0, 0.12, 0.5)]
    f = L.fundamentals(spark.createDataFrame(rows, FILING), price(spark)).first()
    assert (f.per, f.pbr, f.roe) == (40.0, 5.0, 0.12)
    assert f.sales_yoy == pytest.approx(0.2) and f.operating_profit_yoy == pytest.approx(0.5)
    early = L.fundamentals(spark.createDataFrame(rows, FILING), price(spark, when="2024-06-01")).first()
    assert early.sales_yoy is None and early.disclosure_date == day("2024-05-10")


def test_same_day_filings_are_one_whatever_their_order(spark):
    rows = [
        filing("2025-05-10", "15:00:00", "100", "FY", "2025-03-31", "2025-03-31", 100.0, 10.0, 25.0, 100.0, 0.1, 0.4), filing("2025-05-10", "16:00:00", "101", "FY", "2025-03-31", "2025-03-31", 120.0, None, 30.0, None, None, None, 40.0),
    ]
    for some in (rows, rows[::-1]):
        (r,) = L.coalesce_same_day(spark.createDataFrame(some, FILING)).collect()
        assert (r.sales, r.eps, r.forecast_eps, r.disclosure_number, r.bps) == (120.0, 30.0, 40.0, "101", 100.0)


def test_ranks_confidence_and_qualitative_deltas(spark):
    who = spark.createDataFrame([(c, c, "s", "general") for c in ("1111", "2222", "3333")], "canonical_code string, company_name string, sector33_name string, model_group string")
    px = spark.createDataFrame([("1111", 91.0, 82.0), ("2222", 20.0, 30.0), ("3333", None, None)], "canonical_code string, momentum_score double, risk_score double")
    px = px.select(F.lit("2026-01-01").cast("date").alias("snapshot_date"), "*", F.lit("2026-01-01").cast("date").alias("price_date"), F.lit(1.0).alias("latest_close"))
    values = [("1111", 11.0, 1.25, 0.2, 0.6, 0.2, 0.3, 0.3, 0.3, 0.1, 1.0), ("2222", 40.0, 5.0, 0.05, 0.2, 0.05, -0.1, -0.1, -0.1, -0.1, 1.0)]
    names = "per pbr roe equity_ratio operating_margin sales_yoy operating_profit_yoy eps_yoy forecast_eps_revision financial_completeness".split()
    fund = spark.createDataFrame(values, "canonical_code string, " + ", ".join(f"{c} double" for c in names)).withColumns({"snapshot_date": F.lit("2026-01-01").cast("date"), "disclosure_date": F.lit("2025-05-10").cast("date")})
    plain = {r.canonical_code: r for r in R.investment_ranks(who, px, fund).collect()}
    assert plain["1111"].rank_6m == plain["1111"].rank_12m == 1
    assert plain["3333"].confidence == pytest.approx(0.4)
    assert json.loads(plain["1111"].positive_reasons)[0]["contribution"] > 0 and len(json.loads(plain["1111"].positive_reasons)) == 3
    q = spark.createDataFrame([("2222", day("2025-06-01"), 100.0, 0.8)], "canonical_code string, disclosure_date date, qualitative_score double, qualitative_confidence double")
    told = {r.canonical_code: r for r in R.investment_ranks(who, px, fund, q).collect()}
    assert told["2222"].score_6m - plain["2222"].score_6m == pytest.approx(4.0) and told["2222"].score_12m - plain["2222"].score_12m == pytest.approx(3.2)


def test_qualitative_score_priority_and_evidence(spark):
    cols = "document_id string, canonical_code string, disclosure_date date, document_type string, analyzed_at timestamp, confidence double, outlook_score double, demand_score double, profitability_score double, risk_control_score double, earnings_quality_score double"
    t = dt.datetime(2025, 1, 1)
    rows = [("a", "1", day("2025-05-10"), "earnings_release", t, 0.8, *[80.0] * 5), ("b", "1", day("2025-05-10"), "forecast_revision", t + dt.timedelta(1), 0.8, *[20.0] * 5)]
    (r,) = D.qualitative_features(spark.createDataFrame(rows, cols), "2025-06-01").collect()
    assert (r.qualitative_score, r.document_count) == (pytest.approx(80.0), 2)
    docs = spark.createDataFrame([("a", "売上は\n増加　した")], "document_id string, text_content string")
    a = spark.createDataFrame([("a", [("demand", "売上は増加した"), ("risk", "ない")])], "document_id string, evidence array<struct<factor:string,excerpt:string>>")
    (e,) = D.check_evidence(a, docs).collect()
    assert len(e.evidence) == 1 and e.confidence == pytest.approx(0.08) and e.rejected == 1


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    frame = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = M.fit_ridge(frame, ["a", "b", "c"], "y", 3.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, w, atol=1e-9)
    p = np.array([r.p for r in frame.select(M.Ridge.loads(model.dumps()).predict().alias("p")).collect()])
    assert np.allclose(np.sort(p), np.sort(y.mean() + z @ w))
    with pytest.raises(ValueError):
        M.fit_ridge(frame.limit(0), ["a"], "y", 1.0)


def test_evaluation_of_a_perfect_order_and_of_nothing(spark):
    rows = [(day(f"2025-0{m}-28"), f"{i:04d}", float(i), float(i) / 100) for m in (1, 2, 3) for i in range(20)]
    frame = spark.createDataFrame(rows, "evaluation_date date, canonical_code string, prediction double, actual double")
    (r,) = M.evaluate_ranking(frame, "prediction", "actual").collect()
    assert (r.rows, r.months, r.mean_spearman_ic, r.mean_top_decile_turnover) == (60, 3, pytest.approx(1.0), 0.0)
    (r,) = M.evaluate_ranking(frame.limit(5), "prediction", "actual").collect()
    assert r.months == 0 and r.mean_spearman_ic is None


def test_temporal_split_purges_labels(spark):
    dates = pd.date_range("2018-01-31", periods=80, freq="ME")
    rows = [(d.date(), (d + pd.DateOffset(months=6)).date()) for d in dates]
    frame, at = M.temporal_split(spark.createDataFrame(rows, "evaluation_date date, e date"), "e")
    got = frame.collect()
    assert all(r.e < at["validation_start"] for r in got if r.in_train) and any(r.in_train for r in got)
    assert all(r.e < at["test_start"] for r in got if r.in_validation)
    with pytest.raises(ValueError):
        M.temporal_split(spark.createDataFrame(rows[:10], "evaluation_date date, e date"), "e")


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, 10, 20), (2, 5, 6)], "id int, a int, b int")
    got = {r.id: (r.a, r.b) for r in O.upsert(old, spark.createDataFrame([(1, 11), (3, 7), (3, 6)], "id int, a int"), ["id"], [F.desc("a")]).collect()}
    assert got == {1: (11, 20), 2: (5, 6), 3: (7, None)}
    assert O.insert_new(old, spark.createDataFrame([(1, 0, 0), (4, 1, 1)], "id int, a int, b int"), ["id"], [F.col("a")]).count() == 3
    with pytest.raises(ValueError):
        O.upsert_by_position(old, old.select("id", "a"), ["id"], [F.col("a")])


def test_catch_up(spark):
    one = lambda m: spark.range(1).select(O.catch_up(F.lit(m), F.lit("2026-05-20").cast("date")).alias("d")).first().d
    assert [d.day for d in one("2026-05-01")] == [2, 3, 4, 5, 6, 7, 8] and one("2026-05-20") == [] and one(None) == [day("2026-05-20")]


def test_fetch_windows_and_the_horizon_of_a_source(spark):
    got = spark.createDataFrame([(n,) for n in (0, 26, 30, 31, 81, 90, 91, None)], "g int").select(O.fetch_window(F.col("g")).alias("w"))
    assert [r.w for r in got.collect()] == ["1mo", "1mo", "1mo", "3mo", "3mo", "3mo", "2y", "2y"]
    kept = spark.createDataFrame([("2026-01-01",), ("2026-05-01",), (None,)], "m string").select(O.within_horizon(F.col("m"), F.lit("2026-05-20")).alias("k"))
    assert [r.k for r in kept.collect()] == [day("2026-04-19"), day("2026-05-01"), None]


def test_runs_are_journalled(spark):
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    runs = spark.createDataFrame([("a", dt.datetime(2026, 1, 2, 1), "running", "slow"), ("b", dt.datetime(2026, 1, 2, 11), "running", None)], "batch_run_id string, started_at timestamp, status string, message string")
    runs = runs.withColumns({"scheduled_date": F.lit("2026-01-02").cast("date"), "finished_at": F.lit(None).cast("timestamp"), "pipeline_version": F.lit("v")})
    runs = O.finish_run(O.start_run(runs, "c", "2026-01-02", now, "v"), "c", "succeeded", now, "x" * 5000)
    got = {r.batch_run_id: (r.status, r.message and len(r.message), r.finished_at is not None) for r in runs.collect()}
    assert got == {"a": ("aborted", len("slow recovered as stale"), True), "b": ("running", None, False), "c": ("succeeded", 4000, True)}
    marks = spark.createDataFrame([], "source string, stream string, watermark_value string, updated_at timestamp, batch_run_id string")
    for value in ("2026-01-01", "2026-01-02"):
        marks = O.set_watermark(marks, "s", "t", value, now)
    assert O.watermark(marks, "s", "t") == "2026-01-02" and O.watermark(marks, "s", "u") is None and marks.count() == 1


def test_retries_wait_once_and_are_resolved(spark):
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    queue = spark.createDataFrame([], "retry_id string, source string, item_key string, action string, attempt_count int, next_attempt_at timestamp, status string, last_error string, created_at timestamp, updated_at timestamp")
    failed = spark.createDataFrame([("tdnet", "a", "e1"), ("tdnet", "a", "e2"), ("tdnet", "b", None)], "source string, item_key string, error string")
    queue = O.requeue(O.requeue(queue, failed, now), failed.where("item_key = 'a'"), now)
    got = {r.item_key: (r.status, r.last_error, r.attempt_count, r.next_attempt_at) for r in queue.collect()}
    assert got == {"a": ("pending", "e2", 1, dt.datetime(2026, 1, 2, 12, 15)), "b": ("pending", "", 1, dt.datetime(2026, 1, 2, 12, 15))} and queue.count() == 2
    assert {r.item_key: r.status for r in O.resolve(queue, "tdnet", now, "b").collect()} == {"a": "pending", "b": "resolved"}


def test_disclosure_list_pages(spark):
    html = """<table><tr><td class="oddnew-L kjTime">15:00</td><td class="kjCode">72030</td><td class="kjName">　A  B</td><td class="kjTitle"><a href="1401.pdf">決算短信</a></td><td class="kjPlace">東</td>
      <td class="kjXbrl">figures: <a href="x.zip">here</a></td><td class="kjHistroy"></td></tr>
      <tr id="2"><td class="kjTime">16:00</td><td class="kjCode">332A0</td><td class="kjTitle"><a href="sub/1402.pdf">配当予想の変更</a></td></tr>
      <tr id="3"><td class="kjCode">1</td></tr></table>
      <a href="I_list_001_20260105.html">1</a><a href="I_list_012_20260105.html">12</a>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string")
    items = web.disclosure_list(pages)
    got = {r.document_id: r for r in items.collect()}
    assert set(got) == {"tdnet:1401", "tdnet:1402"} and got["tdnet:1401"].company_name == "A B" and got["tdnet:1401"].xbrl_href == "x.zip"
    assert got["tdnet:1402"].canonical_code == "332A" and got["tdnet:1402"].xbrl_href is None and got["tdnet:1402"].exchange == ""
    assert [r.n for r in pages.orderBy("page").select(F.coalesce(web.list_pages(F.col("html"), "2026-01-05"), F.lit(1)).alias("n")).collect()] == [12, 1, 1]
    assert [r.document_id for r in web.select_disclosures(items.union(items), ("earnings_release", "dividend_revision"), limit=1).collect()] == ["tdnet:1402"]
    assert [r.document_id for r in web.select_disclosures(items, code="72030").collect()] == ["tdnet:1401"]


def test_availability_of_a_model_input_needs_both(spark):
    row = {c: 1.0 for c in O.PRICE_LAYER[:3]} | {c: None for c in O.PRICE_LAYER[3:]} | {c: None for c in O.FINANCIAL_LAYER} | dict.fromkeys("price_date disclosure_date forward_return_6m forward_return_12m".split())
    schema = ", ".join(f"{c} double" for c in row)
    f = spark.createDataFrame([tuple(row.values()), tuple((row | {"financial_completeness": 0.5}).values())], schema).withColumn("canonical_code", F.lit("1"))
    got = [r.asDict() for r in O.availability(f).collect()]
    assert [(r["price_features"], r["financial_features"], r["model_input"], r["label_6m"]) for r in got] == [(1, 0, 0, 0), (1, 1, 1, 0)]


def test_watchlist_order_of_sizes(spark):
    rows = [("2026-01-01", c, c, O.MARKETS[0], "銀行業" if c == "1001" else "機械", f"TOPIX {s}") for c, s in (("1001", "Mid400"), ("1002", "Large70"), ("1003", "Core30"), ("1004", "Mid400"))]
    got = O.watchlist(spark.createDataFrame(rows, "as_of_date string, code string, company_name string, market_segment string, sector33_name string, size_name string"), limit=3).orderBy("selection_rank").collect()
    assert [r.canonical_code for r in got] == ["1003", "1002", "1001"] and got[2].model_group == "financial"


def test_titles_codes_and_html(spark):
    titles = {
        "2027年3月期 第1四半期決算短信〔日本基準〕": "earnings_release", "2026年12月期 決算説明資料": "earnings_presentation", "通期業績予想の修正に関するお知らせ": "forecast_revision", "配当予想の変更について": "dividend_revision",
        "決算発表日の変更について": "earnings_schedule", "自己株式取得について": "other", "業績予想の変更": "forecast_revision", "決算概要": "earnings_presentation", "配当予想に関するお知らせ": "other", "決算〔IFRS〕": "earnings_release", "（訂正）報告書": "other",
    }
    f = spark.createDataFrame([(t,) for t in titles], "t string").select("t", D.title_class(F.col("t")).alias("k"))
    assert {r.t: r.k for r in f.collect()} == titles
    codes = spark.createDataFrame([("72030",), ("332A0",), ("332A",), ("　332a0.t ",), (None,)], "c string").select(kit.canonical_code(F.col("c")).alias("c"))
    assert [r.c for r in codes.collect()] == ["7203", "332A", "332A", "332A", None]
    listed = spark.createDataFrame([("7203",), ("25935",)], "c string").select(kit.provider_symbol(F.col("c"), "listing").alias("l"), kit.provider_symbol(F.col("c"), "quotes").alias("q"))
    assert [(r.l, r.q) for r in listed.collect()] == [("72030", "7203.T"), ("25935", "25935.T")]
    assert web.visible("<p>a<script>x</script> b</p><div>c&amp;d</div>") == "a b\n\nc&d" and web.visible("") == "" and web.visible(None) is None
    assert web.visible("<h1>t</h1><noscript>n</noscript><td>c</td><br><br><br>z") == "tnc\n\nz"
    pages = spark.createDataFrame([("<a href='?page=1'></a><a href='?page=12'></a>",), ("",)], "h string")
    assert [r.n for r in pages.select(web.page_numbers(F.col("h")).alias("n")).collect()] == [12, 1]


def test_wide_download_becomes_long(spark):
    cols = [f"{f} 7203.T" for f in "Open|High|Low|Close|Adj Close|Volume".split("|")]
    wide = spark.createDataFrame([(day("2026-01-05"), 1.0, 2.0, 0.5, 1.5, 1.4, 10.0), (day("2026-01-06"), 1.0, 2.0, 0.5, 1.5, 1.4, 10.0)], "Date date, " + ", ".join(f"`{c}` double" for c in cols))
    got = web.long_bars(wide, ["7203.T"]).collect()
    assert len(got) == 2 and got[0].canonical_code == "7203" and got[0].available_at == dt.datetime(2026, 1, 5, 6, 30)


def test_stream_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    frame.coalesce(1).write.parquet(str(source))
    table = VersionedTable(spark, str(tmp_path / "table"), ["k"], [F.desc("t")])
    for _ in range(2):
        ingest(spark, str(source), frame.schema, table, str(tmp_path / "checkpoint"))
    spark.createDataFrame([(2, 9, "z")], "k int, t int, v string").coalesce(1).write.mode("append").parquet(str(source))
    ingest(spark, str(source), frame.schema, table, str(tmp_path / "checkpoint"))
    assert {r.k: r.v for r in table.read().collect()} == {1: "b", 2: "z"}


@pytest.mark.parametrize("rows", [40, 10**6])
def test_ranks_and_quantiles_of_groups_in_pieces(spark, monkeypatch, rows):
    monkeypatch.setattr(order, "ROWS", rows)
    draw = np.random.default_rng(5)
    values = {"a": draw.normal(size=900), "b": np.round(draw.exponential(size=700), 1), "c": np.repeat([0.0, 3.0], [600, 5]), "d": draw.normal(size=7), None: np.arange(60.0)}
    rows_ = [(g, k, float(v)) for g, vs in values.items() for k, v in enumerate(vs)] + [("a", 1000, None), ("d", 1000, None)]
    frame = spark.createDataFrame(rows_, "g string, k int, v double").repartition(3)
    groups = order.cut(frame, ["g"], "v")
    assert set(groups) == ({(g,) for g, vs in values.items() if len(vs) > 40} if rows == 40 else set())
    got = {(r.g, r.k): r for r in order.ranks(order.pieces(frame, ["g"], "v", ["k"], groups), ["g"], "v").collect()}
    high = {(r.g, r.k): r.v for r in order.places(frame, ["v"], ["g"], ["g", "k"]).collect()}
    qs = (0.0, 0.025, 0.05, 0.5, 0.975, 1.0)
    found = order.quantiles(frame, ["g"], "v", qs)
    for g, vs in values.items():
        for k, v in enumerate(vs):
            r = got[g, k]
            assert (r._rank, r._ties, r._n, high[g, k]) == (1 + (vs < v).sum(), (vs == v).sum(), len(vs), 1 + (vs > v).sum())
        for q, (v, less, upto) in zip(qs, found[g,]):
            assert v == pytest.approx(np.quantile(vs, q), abs=1e-12) and (less, upto) == ((vs < v).sum(), (vs <= v).sum())
    assert got["a", 1000]._rank is None and high["d", 1000] is None and len(got) == len(high) == len(rows_)


def test_metric_scores_do_not_depend_on_pieces_and_no_piece_is_a_whole_group(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(k, "m" if k % 4 else "n", None if k % 9 == 0 else str(k % 3), float(draw.standard_cauchy()), float(draw.integers(6)) if k % 7 else None) for k in range(1200)]
    frame = spark.createDataFrame(rows, "canonical_code int, model_group string, sector33_name string, per double, roe double")
    score = lambda: {r.canonical_code: tuple(r) for r in R.metric_scores(frame, {"per": False, "roe": True}).collect()}
    whole = score()
    monkeypatch.setattr(order, "ROWS", 50)
    seen, pieces = [], order.pieces
    monkeypatch.setattr(order, "pieces", lambda f, by, *rest: seen.append((pieces(f, by, *rest), order.piece(by))) or seen[-1][0])
    assert score() == whole and len(whole) == 1200
    long, piece = seen[0]
    assert max(r["count"] for r in long.groupBy(*piece).count().collect()) < 200


def test_summary_collects_no_column_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 100)
    draw = np.random.default_rng(7)
    x, y = draw.normal(size=2000), np.round(draw.exponential(size=2000), 1)
    frame = spark.createDataFrame([(float(a), float(b) if k % 4 else None, None) for k, (a, b) in enumerate(zip(x, y))], "x double, y double, z double")
    out = M.summary(frame, ["x", "y", "z"])
    got = {r.metric: r for r in out.collect()}
    for c, v in (("x", x), ("y", y[np.arange(2000) % 4 > 0])):
        assert (got[c].n, got[c].missing_rate) == (len(v), 1 - len(v) / 2000)
        assert (got[c].p05, got[c]["median"], got[c].p95) == pytest.approx(tuple(np.quantile(v, (0.05, 0.5, 0.95))), abs=1e-12)
    assert (got["z"].n, got["z"].missing_rate, got["z"]["median"]) == (0, 1.0, None)
    assert M.summary(frame.where("x IS NULL"), ["x", "y", "z"]).count() == 0
    assert "percentile" not in out._jdf.queryExecution().toString()
