"""Saved responses, lists, journals, queues and reports on the driver's tables, with their equivalents in SQL.

Responses and pages are written out of the tables' rows and read back, so that SQL can say what must come of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import settle
from kabunoki.operators import documents as D
from kabunoki.operators import learning as M
from kabunoki.operators import operations as O
from kabunoki.operators import publication as U
from kabunoki.operators import ranking as R
from kabunoki.plans.market import pct, r, rounded
from kabunoki.session import load, workspace
from kabunoki.sources import saved, web

NOW = "2024-02-01 00:00:00"


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


#: A response, as a page, has rows of so many successive keys at most: more rows make more responses, not longer ones.
KEYS = 10_000


def _response(rows: DataFrame, by: F.Column, name: str, row: F.Column, key: F.Column) -> DataFrame:
    """JSON documents for each value of ``by``, one for each run of KEYS keys."""
    return rows.groupBy(by.alias("g"), F.floor(key / KEYS).alias("run")).agg(F.collect_list(row).alias(name)).select(F.to_json(F.struct(name)).alias("content"), _now().alias("retrieved_at"))


def _day(key: str, days: int = 300) -> F.Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(key), F.lit(days)).cast("int"))


_DAY = lambda key, days=300: f"CAST(DATE '2024-01-01' + CAST({key} % {days} AS INT) AS DATE)"


def _saved_bars(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    code = F.col("o_custkey").cast("string")
    new = F.struct(F.date_format(_day("o_orderkey"), "yyyyMMdd").alias("Date"), code.alias("Code"), p.alias("O"), F.when(k % 5 == 0, "n/a").otherwise(p.cast("string")).alias("C"), k.alias("Vo"), (p / 2).alias("AdjC"))
    old = F.struct(_day("o_orderkey").cast("string").alias("Date"), code.alias("Code"), p.alias("Open"), p.cast("string").alias("Close"), F.lit("").alias("Volume"), (p / 2).alias("AdjustmentClose"))
    short = _response(o.where(k % 2 == 0), k % 7, "data", new, k)
    long = _response(o.where(k % 2 == 1), k % 7, "daily_quotes", old, k)
    out = saved.bars(short.unionByName(long))
    return rounded(out.select("code", "trade_date", "source", "volume", "open", "high", "close", "adjusted_close"), 4)


def _saved_filings(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    row = F.struct(
        F.when(k % 9 == 0, "soon").otherwise(_day("o_orderkey").cast("string")).alias("DiscDate"), F.lit("15:00:00").alias("DiscTime"), F.col("o_custkey").cast("string").alias("Code"), k.cast("string").alias("DiscNo"), p.cast("string").alias("Sales"),
        F.when(k % 4 == 0, "").otherwise((p / 10).cast("string")).alias("OP"), F.when(k % 3 != 0, p / 100).alias("EPS"), (k % 100).alias("ROE"),
    )
    out = saved.filings(_response(o, k % 11, "data", row, k))
    return rounded(out.select("disclosure_number", "disclosure_date", "disclosure_time", "code", "sales", "operating_profit", "eps", "roe", "bps", "current_period_end", "source"), 4)


def _saved_documents(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents")
    row = F.struct(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("docID"), F.col("source").alias("filerName"), F.concat(_day("doc_id").cast("string"), F.lit(" 09:30")).alias("submitDateTime"), F.col("lang").alias("docTypeCode"), F.lit("x").alias("periodEnd"))
    out = saved.documents(_response(x, F.col("doc_id") % 5, "results", row, F.col("doc_id")))
    return out.select("document_id", "filer_name", F.col("submitted_at").cast("string").alias("submitted"), "document_type_code", "period_end", "security_code", "source")


def _universe(s: SparkSession, d: str) -> DataFrame:
    names = {jp: en for en, jp in saved.UNIVERSE.items()}
    c = load(s, d, "customer")
    listing = c.select(F.lit("20240131").alias(" 日付 "), F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("コード"), F.col("c_name").alias("銘柄名"), F.col("c_mktsegment").alias("市場・商品区分"), F.col("c_nationkey").alias("33業種コード"))
    return saved.universe(listing, _now()).select(*names.values(), "source")


def _listed(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").where("o_orderkey % 20 = 0")
    k = F.col("o_orderkey").cast("string")
    cell = lambda c, body: F.concat(F.lit(f'<td class="oddnew {c}" nowrap>'), body, F.lit("</td>"))
    link = F.when(F.col("o_orderkey") % 100 != 0, F.concat(F.lit('<a href="pdf/'), k, F.lit('.pdf">決算短信 &amp;　'), k, F.lit("</a>"))).otherwise(F.lit("none"))
    figures = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<div><a href="'), k, F.lit('.zip">XBRL</a></div>'))).otherwise(F.lit(""))
    row = F.concat(F.lit("<tr>"), cell("kjTime", F.lit("15:00")), cell("kjCode", F.concat((F.col("o_custkey") % 9000 + 1000).cast("string"), F.lit("0"))), cell("kjName", F.concat(F.lit(" A\n"), k)), cell("kjTitle", link), cell("kjXbrl", figures), F.lit("</tr>"))
    pages = o.groupBy((F.col("o_orderkey") % 13).alias("page"), F.floor(F.col("o_orderkey") / (20 * KEYS)).alias("run")).agg(F.concat_ws("\n", F.lit("<html><script>x</script><table>"), F.array_sort(F.collect_list(row)), F.lit("</table></html>")).alias("html"))
    out = web.disclosure_list(pages)
    return out.select("document_id", "canonical_code", "disclosure_time", "company_name", "title", "pdf_href", "xbrl_href", D.title_class(F.col("title")).alias("document_type"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").select(F.col("text").alias("content"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), _now().alias("retrieved_at"))
    return saved.texts(x, "7203.T", "2024-05-10", "t", "u").select("document_id", "canonical_code", "disclosure_date", "raw_path", "content_hash", F.length("text_content").cast("long").alias("characters"))


def _journal(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("event_id").cast("string").alias("batch_run_id"), F.col("event_type").alias("step_name"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("processed_count"), F.lit(None).cast("string").alias("message"))


def _updated(s: SparkSession, d: str) -> DataFrame:
    steps = _journal(s, d)
    done = O.update(steps, F.col("step_name") == "click", status="succeeded", finished_at=_now(), processed_count=F.col("attempt") * 10, message=O.journal_message(F.repeat(F.col("step_name"), 1000)))
    one = O.finish_step(done, "7", done.where("batch_run_id = '7'").first()["step_name"], 1, "failed", _now(), "late", processed_count=3)
    return one.select("batch_run_id", "status", F.col("finished_at").isNotNull().cast("long").alias("over"), "processed_count", F.length("message").cast("long").alias("told"))


def _queue(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    k = F.col("event_id")
    old = e.where(k % 2 == 0).select(
        F.concat(F.lit("r"), k.cast("string")).alias("retry_id"), F.when(k % 4 == 0, "tdnet").otherwise("daily").alias("source"), k.cast("string").alias("item_key"), F.lit("a").alias("action"), F.lit(3).alias("attempt_count"),
        F.col("ts").alias("next_attempt_at"), F.when(k % 6 == 0, "pending").otherwise("resolved").alias("status"), F.lit("e").alias("last_error"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    failed = e.where(k % 3 == 0).select(F.lit("tdnet").alias("source"), k.cast("string").alias("item_key"), F.lit("gone").alias("error"))
    out = O.resolve(O.requeue(old, failed, _now()), "daily", _now())
    return out.select("source", "item_key", "status", "attempt_count", "last_error", "next_attempt_at", "updated_at").withColumn("attempt_count", F.col("attempt_count").cast("long"))


def _marks(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").groupBy("user_id", "event_type").agg(F.max(F.to_date("ts")).alias("m"))
    marks = e.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("stream"), F.col("m").cast("string").alias("watermark_value"), _now().alias("updated_at"), F.lit("b").alias("batch_run_id"))
    marks = O.set_watermark(O.set_watermark(marks, "1", "click", "2024-03-01", _now(), "c"), "new", "x", "2024-03-02", _now())
    return marks.select("source", "stream", "watermark_value", "batch_run_id")


def _horizon(s: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("c_custkey") % 10 != 0, F.date_add(F.lit("2026-03-01").cast("date"), (F.col("c_custkey") % 90).cast("int")))
    today = F.lit("2026-05-20").cast("date")
    kept = O.within_horizon(mark, today)
    return load(s, d, "customer").select("c_custkey", kept.alias("kept"), F.size(O.catch_up(kept, F.date_sub(today, 1))).cast("long").alias("days"), O.fetch_window(F.datediff(today, mark)).alias("fetched"))


def _analyses(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = load(s, d, "documents").where("doc_id < 400")
    k = F.col("doc_id")
    docs = x.select(k.alias("document_id"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.col("text").alias("text_content"))
    item = lambda e: F.struct(F.lit("f").alias("factor"), e.alias("excerpt"))
    said = F.when(k % 5 == 0, F.lit("[]")).when(k % 7 == 0, F.lit(None)).otherwise(F.to_json(F.array(item(F.substring("text", 1, 12)), item(F.lit("never said §§")))))
    a = x.select(
        k.alias("document_id"), F.col("source").alias("canonical_code"), _day("doc_id").alias("disclosure_date"), F.when(k % 3 == 0, "n").otherwise("m").alias("model"), F.lit("p").alias("prompt_version"), F.lit("s").alias("summary"),
        *[(k % 50).cast("double").alias(c) for c in D.WEIGHTS], (k % 10 / 10.0).alias("confidence"), said.alias("evidence"), F.when(k % 2 == 0, k).alias("input_tokens"), (k * 2).alias("output_tokens"), F.lit("u").alias("source_url"),
    )
    who = x.select(F.col("source").alias("canonical_code")).distinct().where(F.length("canonical_code") > 3).select("canonical_code", F.upper("canonical_code").alias("company_name"), F.substring("canonical_code", 1, 1).alias("sector33_name"))
    return a, docs, who


def _review(s: SparkSession, d: str) -> DataFrame:
    return rounded(D.evaluation_rows(*_analyses(s, d), "m", "p").drop("evidence_json"))


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    return rounded(D.evaluation_summary(D.evaluation_rows(*_analyses(s, d), "m", "p")))


def _csv(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer").select("c_custkey", F.concat(F.lit('a "b", '), F.col("c_name"), F.lit("\nc")).alias("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    path = f"{workspace(s)}/csv-{uuid.uuid4().hex}"
    saved.write_csv(c, path, mark=True)
    return saved.read_csv(s, path, "c_custkey long, c_name string, c_acctbal double")


def _matrix(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").where("year(o_orderdate) = 1996 AND month(o_orderdate) <= 4").select(F.concat(F.lit("N"), (F.col("o_custkey") % 40).cast("string")).alias("canonical_code"), F.last_day("o_orderdate").alias("evaluation_date"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("forward_return_6m"))
    codes = load(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_code"), F.col("n_name").alias("company_name"), ((F.col("n_nationkey") * 7) % 25).alias("model_rank"))
    return O.availability_matrix(o, O.LAYERS["label_6m"], codes, codes, 30)


def _counters(s: SparkSession, d: str) -> DataFrame:
    from kabunoki.plans.records import QUERIES as records

    return O.coverage_counters(records["coverage_matrix"](s, d))


def _sectors(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("canonical_code"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("string")).alias("sector33_name"), F.col("c_acctbal").alias("score_12m"))
    return rounded(O.sector_summary(c))


def _events(s: SparkSession, d: str) -> DataFrame:
    from kabunoki.plans.companies import filings

    f = filings(s, d).select(F.col("code").alias("canonical_code"), "disclosure_date", F.when(F.col("current_period_type") != "2Q", F.col("current_period_type")).alias("current_period_type"), "document_type")
    inputs = load(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit("0")).alias("canonical_code"), F.col("c_name").alias("company_name"), (F.col("c_custkey") % 10).alias("rank_6m"))
    codes = O.ranked_codes(inputs.where("c_custkey < 1000"), 20)
    return O.disclosure_events(f, codes, ("1997-01-01", "1999-12-31")).join(codes.select("canonical_code", "place", F.col("label").alias("ticker")), "canonical_code")


def _inputs(s: SparkSession, d: str) -> DataFrame:
    c, k = load(s, d, "customer"), F.col("c_custkey")
    code, day = k.cast("string").alias("canonical_code"), F.lit("2026-01-01").cast("date").alias("snapshot_date")
    ranks = c.select(code, day, (k % 50).cast("long").alias("rank_12m"), F.when(k % 9 == 0, "old").otherwise("v").alias("ranking_version"))
    who = c.where(k % 11 != 0).select(code, F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("sector33_name"))
    feature = lambda name, n, keep: c.where(keep).select(code, day, F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("calculated_at"), F.lit("f").alias("feature_version")).withColumn(name, F.col("canonical_code").cast("double") + F.col("calculated_at"))
    return U.model_inputs(ranks, who, feature("latest_close", 3, k % 2 == 0), feature("per", 2, k % 3 == 0), feature("document_count", 1, k % 5 == 0), "2026-01-01", "v").drop("snapshot_date")


def _symbols(s: SparkSession, d: str) -> DataFrame:
    c, k = load(s, d, "customer"), F.col("c_custkey")
    members = c.select(k.cast("string").alias("canonical_code"), F.when(k % 3 == 0, "v").otherwise("w").alias("watchlist_name"), F.when(k % 2 == 0, "2024-01-01").otherwise("2023-12-01").alias("as_of_date"), k.alias("selection_rank"))
    symbols = c.select(k.cast("string").alias("canonical_code"), F.explode(F.array(F.lit("listing"), F.lit("quotes"))).alias("provider")).withColumn("provider_symbol", F.concat("canonical_code", F.col("provider")))
    return O.watchlist_symbols(members, symbols, "w", "quotes", 40)


def _top(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("canonical_code"), F.col("c_mktsegment").alias("model_group"), (F.col("c_custkey") % 30).cast("long").alias("rank_12m"))
    return R.top(c, 10).withColumn("kind", F.lit("all")).unionByName(R.top(c, 3, by=["model_group"]).withColumn("kind", F.lit("group")))


MODEL = M.Ridge(["per_pct", "roe_pct", "log_average_turnover_20d_pct"], [0.5, 0.4, 0.3], [0.25, 0.5, 0.125], [0.01, 0.02, -0.03], 0.05, 10.0)


def _infer(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    x = load(s, d, "customer").select(k.cast("string").alias("canonical_code"), F.lit("2024-01-31").cast("date").alias("snapshot_date"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("per"), (k % 37).cast("double").alias("roe"), F.col("c_acctbal").alias("average_turnover_20d"))
    out = M.infer(x, MODEL, "6m", run="r").select("canonical_code", settle(F.col("model_score")).alias("model_score"), "horizon", "model_run")
    return out.withColumn("model_rank", R.rank_desc(F.col("model_score"), "horizon"))


def _trained(s: SparkSession, d: str) -> DataFrame:
    """Training on months of a made-up cross-section, stored as a run, and evaluated from there."""
    k, m = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(60)).cast("int")
    o = load(s, d, "orders").where("o_orderkey <= 6000")
    features = {c: F.when(F.pmod(F.hash(k, F.lit(i)), F.lit(11)) != 0, F.pmod(F.hash(k, F.lit(i)), F.lit(1000)) / 1000.0) for i, c in enumerate(M.FEATURES[:5])}
    x = o.select(F.last_day(F.add_months(F.lit("2018-01-01").cast("date"), m)).alias("evaluation_date"), k.cast("string").alias("canonical_code"), *[v.alias(c) for c, v in features.items()])
    x = x.withColumns({"label_end_date_6m": F.add_months("evaluation_date", 6), "forward_return_6m": F.coalesce(F.col(M.FEATURES[0]), F.lit(0.5)) + F.pmod(F.hash("canonical_code"), F.lit(100)) / 200.0, "rule_score_6m": F.coalesce(F.col(M.FEATURES[1]), F.lit(0.5))})
    report, predictions, model = M.train(x, "6m", features=M.FEATURES[:5])
    root = f"{workspace(s)}/models-{uuid.uuid4().hex}"
    U.save_models(s, root, "run", {"6m": model}, report, {"6m": predictions})
    return rounded(U.evaluate_model(s, root, "6m"))


def _by_position(s: SparkSession, d: str) -> DataFrame:
    from kabunoki.plans.records import _control

    old, new = _control(s, d)
    return O.upsert_by_position(old, new.select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b"), F.lit(2.0).alias("c")), ["o_orderkey"], [F.col("o_orderstatus")])


QUERIES = {
    "saved_bars": _saved_bars,
    "saved_filings": _saved_filings,
    "saved_documents": _saved_documents,
    "universe_rows": _universe,
    "disclosure_rows": _listed,
    "text_ingest": _texts,
    "journal_updates": _updated,
    "retry_queue": _queue,
    "watermarks": _marks,
    "fetch_plan": _horizon,
    "qualitative_review": _review,
    "qualitative_review_summary": _reviewed,
    "csv_round_trip": _csv,
    "availability_matrix": _matrix,
    "coverage_counters": _counters,
    "sector_summary": _sectors,
    "disclosure_events": _events,
    "model_inputs": _inputs,
    "watchlist_symbols": _symbols,
    "top_ranked": _top,
    "model_inference": _infer,
    "model_training": _trained,
    "positional_upsert": _by_position,
}

_ANALYSES = f"""a AS (SELECT doc_id, source AS canonical_code, {_DAY('doc_id')} AS disclosure_date, text, doc_id % 5 = 0 OR doc_id % 7 = 0 AS none_ FROM documents WHERE doc_id < 400 AND doc_id % 3 <> 0),
  j AS (SELECT a.*, CASE WHEN length(canonical_code) > 3 THEN upper(canonical_code) END AS company_name, CASE WHEN length(canonical_code) > 3 THEN canonical_code[1:1] END AS sector33_name, CASE WHEN none_ THEN 0 ELSE 2 END AS evidence_count,
    CASE WHEN none_ THEN 0 ELSE 1 END AS evidence_found, CASE WHEN none_ THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS evidence_match_rate, CAST(doc_id % 10 / 10.0::DOUBLE AS DOUBLE) AS validated_confidence, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS input_tokens, doc_id * 2 AS output_tokens FROM a)"""
_CTL = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'X' AS o_orderstatus, 2.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"

SQL = {
    "saved_bars": f"""SELECT {_DAY('o_orderkey')} AS trade_date, CAST(o_custkey AS VARCHAR) AS code, {r('o_totalprice', 4)} AS open, CAST(NULL AS DOUBLE) AS high, {r('CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 5 <> 0 THEN o_totalprice END', 4)} AS close,
      {r('CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END', 4)} AS volume, {r('o_totalprice / 2', 4)} AS adjusted_close, 'jquants_v2' AS source FROM orders""",
    "saved_filings": f"""SELECT CAST(o_orderkey AS VARCHAR) AS disclosure_number, CASE WHEN o_orderkey % 9 <> 0 THEN {_DAY('o_orderkey')} END AS disclosure_date, '15:00:00' AS disclosure_time, CAST(o_custkey AS VARCHAR) AS code, {r('o_totalprice', 4)} AS sales,
      {r('CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 10 END', 4)} AS operating_profit, {r('CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 100 END', 4)} AS eps, {r('o_orderkey % 100', 4)} AS roe, CAST(NULL AS DOUBLE) AS bps, CAST(NULL AS DATE) AS current_period_end, 'jquants_v2' AS source FROM orders""",
    "saved_documents": f"SELECT 'S' || doc_id AS document_id, source AS filer_name, strftime({_DAY('doc_id')}, '%Y-%m-%d') || ' 09:30:00' AS submitted, lang AS document_type_code, CAST(NULL AS DATE) AS period_end, CAST(NULL AS VARCHAR) AS security_code, 'edinet_v2' AS source FROM documents",
    "universe_rows": "SELECT '20240131' AS as_of_date, CAST(c_custkey AS VARCHAR) AS code, c_name AS company_name, c_mktsegment AS market_segment, CAST(c_nationkey AS VARCHAR) AS sector33_code, CAST(NULL AS VARCHAR) AS sector33_name, CAST(NULL AS VARCHAR) AS sector17_code, CAST(NULL AS VARCHAR) AS sector17_name, CAST(NULL AS VARCHAR) AS size_code, CAST(NULL AS VARCHAR) AS size_name, 'jpx' AS source FROM customer",
    "disclosure_rows": """SELECT 'tdnet:' || o_orderkey AS document_id, CAST(o_custkey % 9000 + 1000 AS VARCHAR) AS canonical_code, '15:00' AS disclosure_time, 'A ' || o_orderkey AS company_name, '決算短信 & ' || o_orderkey AS title, 'pdf/' || o_orderkey || '.pdf' AS pdf_href,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.zip' END AS xbrl_href, 'earnings_release' AS document_type FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 100 <> 0""",
    "text_ingest": "SELECT 'manual:7203.T:2024-05-10:' || sha256(text)[1:16] AS document_id, '7203' AS canonical_code, DATE '2024-05-10' AS disclosure_date, '/in/' || doc_id AS raw_path, sha256(text) AS content_hash, length(text) AS characters FROM documents",
    "journal_updates": """SELECT CAST(event_id AS VARCHAR) AS batch_run_id, CASE WHEN event_id = 7 THEN 'failed' WHEN event_type = 'click' THEN 'succeeded' ELSE 'running' END AS status, CAST(event_id = 7 OR event_type = 'click' AS BIGINT) AS over,
      CASE WHEN event_id = 7 THEN 3 WHEN event_type = 'click' THEN event_id % 3 * 10 ELSE 0 END AS processed_count, CASE WHEN event_id = 7 THEN 4 WHEN event_type = 'click' THEN 4000 END AS told FROM events""",
    "retry_queue": f"""WITH old AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'tdnet' ELSE 'daily' END AS source, event_id, CASE WHEN event_id % 6 = 0 THEN 'pending' ELSE 'resolved' END AS status, ts FROM events WHERE event_id % 2 = 0)
      SELECT source, CAST(event_id AS VARCHAR) AS item_key, 'resolved' AS status, CAST(3 AS BIGINT) AS attempt_count, 'e' AS last_error, ts AS next_attempt_at, CASE WHEN source = 'daily' AND status = 'pending' THEN TIMESTAMP '{NOW}' ELSE ts END AS updated_at FROM old WHERE NOT (source = 'tdnet' AND status = 'pending' AND event_id % 3 = 0)
      UNION ALL SELECT 'tdnet', CAST(event_id AS VARCHAR), 'pending', 1, 'gone', TIMESTAMP '2024-02-01 00:15:00', TIMESTAMP '{NOW}' FROM events WHERE event_id % 3 = 0""",
    "watermarks": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source, event_type AS stream, strftime(max(CAST(ts AS DATE)), '%Y-%m-%d') AS watermark_value, 'b' AS batch_run_id FROM events GROUP BY user_id, event_type)
      SELECT * FROM e WHERE NOT (source = '1' AND stream = 'click') UNION ALL SELECT '1', 'click', '2024-03-01', 'c' UNION ALL SELECT 'new', 'x', '2024-03-02', NULL""",
    "fetch_plan": """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CAST(DATE '2026-03-01' + CAST(c_custkey % 90 AS INT) AS DATE) END AS mark FROM customer), k AS (SELECT *, CASE WHEN mark IS NOT NULL THEN greatest(mark, DATE '2026-04-19') END AS kept FROM m)
      SELECT c_custkey, kept, CAST(CASE WHEN kept IS NULL THEN 1 ELSE greatest(0, least(7, date_diff('day', kept, DATE '2026-05-19'))) END AS BIGINT) AS days, CASE WHEN date_diff('day', mark, DATE '2026-05-20') <= 30 THEN '1mo' WHEN date_diff('day', mark, DATE '2026-05-20') <= 90 THEN '3mo' ELSE '2y' END AS fetched FROM k""",
    "qualitative_review": f"""WITH {_ANALYSES} SELECT canonical_code, company_name, sector33_name, disclosure_date, 'T' || doc_id AS title, 's' AS summary, {', '.join(f'CAST(doc_id % 50 AS DOUBLE) AS {c}' for c in D.WEIGHTS)}, {r('validated_confidence')} AS validated_confidence, CAST(evidence_count AS BIGINT) AS evidence_count, CAST(evidence_found AS BIGINT) AS evidence_found, evidence_match_rate, input_tokens, output_tokens, 'u' AS source_url, {', '.join(f"'' AS {c}" for c in D.REVIEW)} FROM j""",
    "qualitative_review_summary": f"WITH {_ANALYSES} SELECT count(*) AS documents, count(DISTINCT canonical_code) AS companies, count(DISTINCT sector33_name) AS sectors, CAST(sum(evidence_count) AS BIGINT) AS evidence_items, {r('sum(evidence_found) / sum(evidence_count)::DOUBLE')} AS evidence_match_rate, {r('avg(validated_confidence)')} AS average_confidence, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM j",
    "csv_round_trip": "SELECT c_custkey, 'a \"b\", ' || c_name || chr(10) || 'c' AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer",
    "availability_matrix": f"""WITH o AS (SELECT 'N' || (o_custkey % 40) AS code, strftime(o_orderdate, '%Y-%m') AS m, o_orderkey % 3 = 0 AS has FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 4),
      c AS (SELECT code, n_name, n_nationkey * 7 % 25 AS rk FROM (SELECT DISTINCT code FROM o) LEFT JOIN nation ON code = 'N' || n_nationkey), p AS (SELECT *, row_number() OVER (ORDER BY rk NULLS LAST, code) AS place FROM c)
      SELECT place, code || ' ' || coalesce(n_name, '-') AS ticker_label, {', '.join(f"CAST(coalesce(bool_or(has) FILTER (WHERE m = '1996-0{i}'), false) AS BIGINT) AS \"1996-0{i}\"" for i in range(1, 5))} FROM p JOIN o USING (code) WHERE place <= 30 GROUP BY 1, 2""",
    "sector_summary": f"SELECT CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS sector33_name, count(*) AS companies, {r('median(c_acctbal)')} AS median_score FROM customer GROUP BY 1",
    "model_inputs": """SELECT CAST(c_custkey AS VARCHAR) AS canonical_code, c_custkey % 50 AS rank_12m, 'v' AS ranking_version, c_name AS company_name, c_mktsegment AS sector33_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 2.0::DOUBLE END AS latest_close,
      CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1.0::DOUBLE END AS per, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 0.0::DOUBLE END AS qualitative_document_count FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 9 <> 0""",
    "watchlist_symbols": "SELECT CAST(c_custkey AS VARCHAR) AS canonical_code, c_custkey || 'quotes' AS provider_symbol, c_custkey AS selection_rank FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0 ORDER BY c_custkey LIMIT 40",
    "top_ranked": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS canonical_code, c_mktsegment AS model_group, c_custkey % 30 AS rank_12m FROM customer)
      (SELECT *, 'all' AS kind FROM c ORDER BY rank_12m, canonical_code LIMIT 10) UNION ALL SELECT *, 'group' FROM c QUALIFY row_number() OVER (PARTITION BY model_group ORDER BY rank_12m, canonical_code) <= 3""",
    "model_inference": f"""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS canonical_code, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS per, CAST(c_custkey % 37 AS DOUBLE) AS roe, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END AS lt, 1 AS one FROM customer),
      q AS (SELECT canonical_code, coalesce({pct('per', 'one')}, 0.5) AS a, coalesce({pct('roe', 'one')}, 0.5) AS b, coalesce({pct('lt', 'one')}, 0.5) AS c FROM x),
      y AS (SELECT canonical_code, {r('0.05::DOUBLE + (a - 0.5) / 0.25::DOUBLE * 0.01::DOUBLE + (b - 0.4::DOUBLE) / 0.5::DOUBLE * 0.02::DOUBLE + (c - 0.3::DOUBLE) / 0.125::DOUBLE * -0.03::DOUBLE')} AS model_score FROM q)
      SELECT canonical_code, model_score, '6m' AS horizon, 'r' AS model_run, rank() OVER (ORDER BY model_score DESC) AS model_rank FROM y""",
    "positional_upsert": f"WITH {_CTL} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new",
}


def _more() -> None:
    from kabunoki.plans.companies import FILED
    from kabunoki.plans.records import SQL as records

    SQL["coverage_counters"] = f"SELECT count(*) AS securities, count(*) FILTER (WHERE price_rows >= 252) AS price_252, count(*) FILTER (WHERE financial_periods >= 3) AS financial_3, count(*) FILTER (WHERE core_coverage_pct = 100) AS core_complete, count(*) FILTER (WHERE source_document_count > 0) AS with_source, count(*) FILTER (WHERE analysis_count > 0) AS with_analysis FROM ({records['coverage_matrix']})"
    SQL["disclosure_events"] = f"""WITH {FILED}, c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '0' AS canonical_code, c_name, row_number() OVER (ORDER BY c_custkey % 10, c_custkey) AS place FROM customer WHERE c_custkey < 1000),
      f AS (SELECT DISTINCT code AS canonical_code, CAST(date_trunc('month', disclosure_date) AS DATE) AS month, disclosure_date, CASE WHEN current_period_type <> '2Q' THEN current_period_type END AS current_period_type, document_type FROM filed WHERE disclosure_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
      SELECT f.*, coalesce(current_period_type, document_type) AS label, place, canonical_code || ' ' || c_name AS ticker FROM f JOIN c USING (canonical_code) WHERE place <= 20"""


_more()
