"""Operations, documents and control tables on the driver's tables, with their equivalents in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import canonical_code, clock_seconds, provider_symbol, squeeze, tokyo_to_utc
from kabunoki.operators import documents as D
from kabunoki.operators import operations as O
from kabunoki.operators import prices as P
from kabunoki.plans.market import BARS, EVENTS, bars, cleaned, r, rounded
from kabunoki.session import load, workspace
from kabunoki.sources import web
from kabunoki.streaming.incremental import VersionedTable, ingest

TITLES = ["2025年3月期　決算短信〔日本基準〕", "決算 説明資料", "業績予想の修正に関するお知らせ", "配当予想の変更について", "決算〔米国基準〕", "決算発表日の変更について", "決算説明会資料", "通期業績予想と実績の差異", "決算概要", "業績予想の変更", "配当予想に関するお知らせ", "決算ハイライト", "自己株式取得について", "決算発表予定"]
TYPES = ["earnings_release", "forecast_revision", "dividend_revision", "earnings_presentation", "other"]


def _day() -> F.Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int"))


def _latest(s: SparkSession, d: str) -> DataFrame:
    return D.first_per_key(load(s, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


def _filtered(s: SparkSession, d: str) -> DataFrame:
    e, key = load(s, d, "events"), F.struct("user_id", "event_type")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("value") > 50, key)).alias("users_over_50"), F.max("ts").alias("last_ts"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TYPES])
    x = load(s, d, "documents")
    scores = {c: F.pmod(F.col("doc_id") * k, F.lit(101)).cast("double") for c, k in zip(D.WEIGHTS, (7, 11, 13, 17, 19))}
    return x.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("source").alias("canonical_code"), _day().alias("disclosure_date"), F.get(names, F.pmod("doc_id", F.lit(5)).cast("int")).alias("document_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("analyzed_at"), (F.pmod("doc_id", F.lit(10)) / 10.0).alias("confidence"), *[v.alias(c) for c, v in scores.items()], "doc_id")


def _qualitative(s: SparkSession, d: str) -> DataFrame:
    return rounded(D.qualitative_features(_typed(s, d), "2024-06-30").drop("feature_version"))


def _missing(s: SparkSession, d: str) -> DataFrame:
    done = load(s, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("m").alias("model"), F.lit("p").alias("prompt_version"))
    return D.missing_analyses(_typed(s, d), done, "m", "p", 50).select("document_id", "disclosure_date", "document_type")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    # The benchmark has a bounded number of items; they are grouped into evidence by a shuffle, not by broadcast.
    b = load(s, d, "benchmark").groupBy(F.pmod("item_id", F.lit(20)).alias("g")).agg(F.collect_list(F.struct(F.pmod("item_id", F.lit(5)).cast("string").alias("factor"), F.col("text").alias("excerpt"))).alias("evidence"))
    x = load(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("text_content"))
    a = x.select("document_id", F.pmod("document_id", F.lit(20)).alias("g")).join(b, "g").drop("g")
    return rounded(D.check_evidence(a, x).select("document_id", F.size("evidence").cast("long").alias("kept"), "rejected", "confidence"))


def _titles(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TITLES])
    t = F.get(names, F.pmod("doc_id", F.lit(len(TITLES))).cast("int"))
    return load(s, d, "documents").select("doc_id", D.title_class(t).alias("document_type"), F.length(squeeze(t)).cast("long").alias("width"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    raw = F.when(m == 0, F.concat(F.lit("　"), k, F.lit("a "))).when(m == 1, F.concat(k, F.lit(".t"))).otherwise(F.concat(k, F.lit("0")))
    code = canonical_code(raw)
    clock = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 7 == 0, "bad").otherwise(F.concat(F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit(":30")))
    return load(s, d, "customer").select(
        "c_custkey", code.alias("canonical_code"), provider_symbol(code, "listing").alias("listed"), provider_symbol(code, "quotes").alias("quoted"), clock_seconds(clock).cast("long").alias("seconds"),
        tokyo_to_utc(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "15:30:00").alias("known_at"),
    )


def _links(s: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return load(s, d, "pages").select("page_id", F.size(web.links(h)).cast("long").alias("n_links"), web.page_numbers(F.col("url")).cast("long").alias("page"), web.content_key(h).alias("content_key"))


def _control(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = load(s, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return old, new


def _upsert(s: SparkSession, d: str) -> DataFrame:
    return O.upsert(*_control(s, d), ["o_orderkey"], [F.col("o_orderstatus")])


def _insert(s: SparkSession, d: str) -> DataFrame:
    old, new = _control(s, d)
    return O.insert_new(old, new.withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"], [F.col("o_orderstatus")])


def _merge(s: SparkSession, d: str) -> DataFrame:
    old, new = _control(s, d)
    return O.merge_documents(old, new.withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"], "o_orderstatus", F.col("o.o_totalprice") > 100000, "discovered")


def _stale(s: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    runs = load(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "running").otherwise("succeeded").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.when(F.col("event_id") % 3 == 0, "late").alias("message"))
    return O.recover_stale(runs, now).groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"), F.count("finished_at").alias("finished"))


def _catch_up(s: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("c_custkey") % 10 != 0, F.date_add(F.lit("2026-05-01").cast("date"), (F.col("c_custkey") % 25).cast("int")))
    return load(s, d, "customer").select("c_custkey", F.explode(O.catch_up(mark, F.lit("2026-05-20").cast("date"))).alias("day"))


def _watchlist(s: SparkSession, d: str) -> DataFrame:
    c, k = load(s, d, "customer"), F.col("c_custkey")
    u = c.select(F.when(k % 2 == 0, "2024-01-01").otherwise("2023-12-01").alias("as_of_date"), k.cast("string").alias("code"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("market_segment"), F.col("c_nationkey").cast("string").alias("sector33_name"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("size_name"))
    return O.watchlist(u, "w", 100, ["S2", "S0", "S4"], ["BUILDING", "MACHINERY"], ["3", "7"])


def _coverage(s: SparkSession, d: str) -> DataFrame:
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("canonical_code")
    n = load(s, d, "nation")
    named = load(s, d, "orders").join(load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(code("c_nationkey"), F.last_day("o_orderdate").alias("disclosure_date"))
    docs = load(s, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("N"), (F.col("doc_id") % 30).cast("string")).alias("canonical_code"), F.col("doc_id").alias("document_id"), _day().alias("disclosure_date"))
    layers = {
        "price": bars(s, d).select("canonical_code", "trade_date"), "financial": named, "fundamental": n.where("n_nationkey % 3 <> 0").select(code("n_nationkey")), "document": docs, "analysis": docs.where("document_id % 2 = 0"),
        "qualitative": n.where("n_nationkey % 4 = 0").select(code("n_nationkey")), "rank": n.where("n_nationkey % 5 <> 0").select(code("n_nationkey"), (F.col("n_nationkey") % 2).cast("double").alias("qualitative_confidence")),
    }
    return O.coverage(n.select(code("n_nationkey"), F.col("n_name").alias("company_name")), layers)


def _months(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    return O.month_counts(b.select("canonical_code", "trade_date"), load(s, d, "nation").where("n_nationkey < 10").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_code")))


def _heatmap(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    kinds = ["click", "error", "login", "purchase", "view"]
    return e.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def _available(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("canonical_code"), *[F.when(F.col("c_custkey") % k != 0, F.col("c_acctbal")).alias(f"x{k}") for k in (2, 3, 5)])
    return O.availability(c, {"all_of": [(["x2", "x3", "x5"], 3)], "two_of": [(["x2", "x3", "x5"], 2)], "first": [(["x2"], 1)], "both": [(["x2", "x3"], 1), (["x5"], 1)]})


def _published(s: SparkSession, d: str) -> DataFrame:
    c = cleaned(s, d)
    return rounded(O.published_prices(bars(s, d), P.quality_events(c)))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return O.row_counts({t: load(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events file as a stream: the latest row per user, ingested twice to the same effect."""
    base = f"{workspace(s)}/stream-{uuid.uuid4().hex}"
    table = VersionedTable(s, f"{base}/table", ["user_id"], [F.desc("ts"), F.desc("event_id")])
    schema = s.read.parquet(f"{d}/events.parquet").schema
    for _ in range(2):
        ingest(s, d, schema, table, f"{base}/checkpoint", "events.parquet")
    return table.read().select("user_id", "event_id", "event_type", "value")


def _gate(s: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_code")
    n = load(s, d, "nation")
    b = bars(s, d)
    ranks = n.select(code, F.lit("2001-12-31").cast("date").alias("snapshot_date"), F.lit("r").alias("ranking_version"), F.lit(0).cast("timestamp").alias("calculated_at"), F.lit(1).alias("rank_6m"), F.lit(1).alias("rank_12m"), F.lit(50.0).alias("score_6m"), F.lit(50.0).alias("score_12m"), F.lit("[]").alias("positive_reasons"), F.when(F.col("n_nationkey") == 3, "{").otherwise("[]").alias("negative_reasons"))
    texts = load(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("text_content"))
    item = load(s, d, "benchmark").groupBy().agg(F.collect_list(F.struct(F.lit("a").alias("factor"), F.col("text").alias("excerpt"))).alias("evidence"))
    t = {
        "members": n.select(code, F.lit("w").alias("watchlist_name"), F.lit("2024-01-01").alias("as_of_date")), "bars": b, "events": P.quality_events(P.clean(b)), "ranks": ranks,
        "filings": n.where("n_nationkey < 22").select(F.col("n_nationkey").cast("string").alias("code")), "symbols": n.select(code, F.lit("jquants_v2").alias("provider"), F.col("n_nationkey").cast("string").alias("provider_symbol")),
        "tdnet": texts.select("document_id", F.lit("downloaded").alias("status"), F.lit("p").alias("pdf_path"), F.length("text_content").alias("text_characters")), "texts": texts,
        "retries": n.where("n_nationkey < 2").select(F.lit("tdnet").alias("source"), F.lit("pending").alias("status")), "analyses": texts.where("document_id < 5").select("document_id").crossJoin(item),
        "qualitative": n.where("n_nationkey < 21").select(code, F.lit("2001-12-31").cast("date").alias("snapshot_date")),
    }
    return O.quality_gate(t, "2002-01-05", "w").select("check_name", "status", "observed_value")


QUERIES = {
    "latest_per_key": _latest,
    "orphans_antijoin": lambda s, d: O.orphans(load(s, d, "customer").select("c_custkey", "c_name"), load(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
    "dup_keys": lambda s, d: O.duplicate_keys(load(s, d, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"]),
    "filter_agg": _filtered,
    "doc_priority_latest": _qualitative,
    "missing_analyses": _missing,
    "evidence_match": _evidence,
    "title_class": _titles,
    "code_norm": _codes,
    "visible_text": lambda s, d: web.visible_text(load(s, d, "pages")).select("page_id", "visible_text"),
    "page_links": _links,
    "keyed_upsert": _upsert,
    "insert_or_ignore": _insert,
    "conditional_merge": _merge,
    "stale_runs": _stale,
    "catch_up_dates": _catch_up,
    "watchlist": _watchlist,
    "coverage_matrix": _coverage,
    "month_grid": _months,
    "event_heatmap": _heatmap,
    "availability": _available,
    "published_prices": _published,
    "row_counts": _counts,
    "incremental_upsert": _stream,
    "quality_gate": _gate,
}

_TYPE = "[" + ", ".join(f"'{t}'" for t in TYPES) + "][doc_id % 5 + 1]"
_SCORES = ", ".join(f"CAST(doc_id * {k} % 101 AS DOUBLE) AS {c}" for c, k in zip(D.WEIGHTS, (7, 11, 13, 17, 19)))
_TYPED = f"typed AS (SELECT doc_id, 'd' || doc_id AS document_id, source AS canonical_code, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS DATE) AS disclosure_date, {_TYPE} AS document_type, (doc_id % 10) / 10.0 AS confidence, {_SCORES} FROM documents)"
_PLACE = "CASE document_type WHEN 'earnings_release' THEN 4 WHEN 'earnings_presentation' THEN 3 WHEN 'forecast_revision' THEN 2 WHEN 'dividend_revision' THEN 1 ELSE 0 END"
_SQ = lambda x: f"regexp_replace({x}, '[\\s\\x{{3000}}]+', '', 'g')"
_OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)"
_TITLE = "[" + ", ".join(f"'{t}'" for t in TITLES) + f"][doc_id % {len(TITLES)} + 1]"

SQL = {
    "latest_per_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "orphans_antijoin": "SELECT c_custkey, c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL",
    "dup_keys": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "filter_agg": "SELECT event_type, count(*) AS n, count(DISTINCT (user_id, event_type)) FILTER (WHERE value > 50) AS users_over_50, max(ts) AS last_ts FROM events GROUP BY 1",
    "doc_priority_latest": f"""WITH {_TYPED}, known AS (SELECT *, row_number() OVER (PARTITION BY canonical_code ORDER BY disclosure_date DESC, {_PLACE} DESC, doc_id DESC) AS rn, count(*) OVER (PARTITION BY canonical_code) AS document_count FROM typed WHERE disclosure_date <= DATE '2024-06-30')
      SELECT DATE '2024-06-30' AS snapshot_date, canonical_code, disclosure_date, {r(' + '.join(f'{c} * {w}' for c, w in D.WEIGHTS.items()))} AS qualitative_score, {', '.join(f'{r(c)} AS {c}' for c in D.WEIGHTS)}, {r('confidence')} AS qualitative_confidence, document_count FROM known WHERE rn = 1""",
    "missing_analyses": f"WITH {_TYPED} SELECT document_id, disclosure_date, document_type FROM typed t WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id) AND document_type <> 'other' ORDER BY disclosure_date, 5 - {_PLACE}, document_id LIMIT 50",
    "evidence_match": f"""WITH e AS (SELECT d.doc_id, b.item_id % 5 AS f, contains({_SQ('d.text')}, {_SQ('b.text')}) AS ok FROM documents d JOIN benchmark b ON b.item_id % 20 = d.doc_id % 20),
      g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE ok) AS k, count(DISTINCT f) FILTER (WHERE ok) AS c FROM e GROUP BY 1) SELECT doc_id AS document_id, k AS kept, n - k AS rejected, {r('0.8::DOUBLE * (k / n::DOUBLE) * (c / 5.0::DOUBLE)')} AS confidence FROM g""",
    "title_class": f"""WITH t AS (SELECT doc_id, {_TITLE} AS t FROM documents) SELECT doc_id, CASE WHEN t LIKE '%決算短信%' OR t LIKE '%決算〔%' THEN 'earnings_release' WHEN regexp_matches(t, '決算(説明|補足|概要|ハイライト)') THEN 'earnings_presentation'
      WHEN t LIKE '%業績予想%' AND (t LIKE '%修正%' OR t LIKE '%差異%' OR t LIKE '%変更%') THEN 'forecast_revision' WHEN t LIKE '%配当予想%' AND (t LIKE '%修正%' OR t LIKE '%変更%') THEN 'dividend_revision'
      WHEN regexp_matches(t, '決算発表(日|予定|時刻)') THEN 'earnings_schedule' ELSE 'other' END AS document_type, length({_SQ('t')}) AS width FROM t""",
    "code_norm": """WITH x AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN c_custkey || 'a' WHEN 1 THEN c_custkey || '' ELSE c_custkey || '0' END AS raw FROM customer),
      y AS (SELECT *, CASE WHEN length(raw) = 5 AND raw[-1] = '0' THEN raw[1:4] ELSE upper(raw) END AS code FROM x)
      SELECT c_custkey, code AS canonical_code, CASE WHEN length(code) < 5 THEN code || '0' ELSE code END AS listed, code || '.T' AS quoted,
      CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN -1 ELSE (c_custkey % 24) * 3600 + 1800 END AS BIGINT) AS seconds, CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS TIMESTAMP) + INTERVAL 390 MINUTE AS known_at FROM y""",
    "page_links": r"""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS n_links, CAST(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), '1') AS BIGINT) AS page, sha256(html) AS content_key FROM pages""",
    "keyed_upsert": f"WITH {_OLD} SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT n.o_orderkey, n.o_orderstatus, o.o_totalprice FROM new n LEFT JOIN old o USING (o_orderkey)",
    "insert_or_ignore": f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT o_orderkey, o_orderstatus, 0.0::DOUBLE FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)",
    "conditional_merge": f"WITH {_OLD} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NOT NULL AND (n.o_orderkey IS NULL OR o.o_totalprice > 100000) THEN o.o_orderstatus ELSE 'discovered' END AS o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN 1.0::DOUBLE ELSE o.o_totalprice END AS o_totalprice FROM old o FULL JOIN new n USING (o_orderkey)",
    "stale_runs": "WITH x AS (SELECT CASE WHEN event_id % 2 = 0 THEN CASE WHEN ts < TIMESTAMP '2024-01-29 18:00:00' THEN 'aborted' ELSE 'running' END ELSE 'succeeded' END AS status, CASE WHEN event_id % 3 = 0 THEN 'late' END AS m FROM events) SELECT status, CASE WHEN status = 'aborted' THEN concat(coalesce(m, ''), ' recovered as stale') ELSE m END AS message, count(*) AS n, count(*) FILTER (WHERE status = 'aborted') AS finished FROM x GROUP BY 1, 2",
    "catch_up_dates": """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN DATE '2026-05-01' + CAST(c_custkey % 25 AS INT) END AS mark FROM customer)
      SELECT c_custkey, CAST(unnest(CASE WHEN mark IS NULL THEN [DATE '2026-05-20'] ELSE list_transform(range(1, least(7, date_diff('day', mark, DATE '2026-05-20')) + 1), lambda i: CAST(mark + CAST(i AS INT) AS DATE)) END) AS DATE) AS day FROM m""",
    "watchlist": """WITH u AS (SELECT *, CASE c_custkey % 5 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS place FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 IN (0, 2, 4) AND c_mktsegment IN ('BUILDING', 'MACHINERY')),
      x AS (SELECT *, row_number() OVER (ORDER BY place, CAST(c_custkey AS VARCHAR)) AS selection_rank FROM u)
      SELECT 'w' AS watchlist_name, '2024-01-01' AS as_of_date, CAST(c_custkey AS VARCHAR) AS canonical_code, c_name AS company_name, c_mktsegment AS market_segment, CAST(c_nationkey AS VARCHAR) AS sector33_name, 'S' || (c_custkey % 5) AS size_name, selection_rank,
      CASE WHEN c_nationkey IN (3, 7) THEN 'financial' ELSE 'general' END AS model_group FROM x WHERE selection_rank <= 100""",
    "coverage_matrix": f"""WITH {BARS}, p AS (SELECT canonical_code, max(trade_date) AS last_price_date, min(trade_date) AS first_price_date, count(*) AS price_rows FROM bars GROUP BY 1),
      f AS (SELECT 'N' || c_nationkey AS canonical_code, count(DISTINCT last_day(o_orderdate)) AS financial_periods, max(last_day(o_orderdate)) AS last_financial_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      docs AS (SELECT 'N' || (doc_id % 30) AS canonical_code, doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS DATE) AS dd FROM documents WHERE doc_id % 3 = 0),
      s AS (SELECT canonical_code, count(*) AS source_document_count, max(dd) AS last_source_document_date FROM docs GROUP BY 1), a AS (SELECT canonical_code, count(DISTINCT doc_id) AS analysis_count, max(dd) AS last_analysis_date FROM docs WHERE doc_id % 2 = 0 GROUP BY 1),
      j AS (SELECT 'N' || n_nationkey AS canonical_code, n_name AS company_name, coalesce(price_rows, 0) AS price_rows, first_price_date, last_price_date, coalesce(financial_periods, 0) AS financial_periods, last_financial_date, CAST(n_nationkey % 3 <> 0 AS BIGINT) AS fundamental_available,
        coalesce(source_document_count, 0) AS source_document_count, last_source_document_date, coalesce(analysis_count, 0) AS analysis_count, last_analysis_date, CAST(n_nationkey % 4 = 0 AS BIGINT) AS qualitative_feature_available, CAST(n_nationkey % 5 <> 0 AND n_nationkey % 2 = 1 AS BIGINT) AS qualitative_used_in_rank, CAST(n_nationkey % 5 <> 0 AS BIGINT) AS ranked
        FROM nation LEFT JOIN p ON p.canonical_code = 'N' || n_nationkey LEFT JOIN f ON f.canonical_code = 'N' || n_nationkey LEFT JOIN s ON s.canonical_code = 'N' || n_nationkey LEFT JOIN a ON a.canonical_code = 'N' || n_nationkey)
      SELECT * EXCLUDE (ranked), 40 * CAST(price_rows >= 252 AS BIGINT) + 40 * CAST(financial_periods >= 3 AS BIGINT) + 20 * ranked AS core_coverage_pct,
        25 * CAST(price_rows >= 252 AS BIGINT) + 25 * CAST(financial_periods >= 3 AS BIGINT) + 15 * ranked + 15 * CAST(source_document_count > 0 AS BIGINT) + 10 * CAST(analysis_count > 0 AS BIGINT) + 10 * qualitative_feature_available AS extended_coverage_pct FROM j""",
    "month_grid": f"""WITH {BARS}, m AS (SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(trade_date) FROM bars)), date_trunc('month', (SELECT max(trade_date) FROM bars)), INTERVAL 1 MONTH)) AS DATE) AS month),
      c AS (SELECT 'N' || n_nationkey AS canonical_code FROM nation WHERE n_nationkey < 10) SELECT c.canonical_code, m.month, count(b.trade_date) AS bars FROM c CROSS JOIN m LEFT JOIN bars b ON b.canonical_code = c.canonical_code AND date_trunc('month', b.trade_date) = m.month GROUP BY 1, 2""",
    "event_heatmap": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in ("click", "error", "login", "purchase", "view")) + " FROM events GROUP BY 1",
    "availability": "WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS canonical_code, c_custkey % 2 <> 0 AS a, c_custkey % 3 <> 0 AS b, c_custkey % 5 <> 0 AS c FROM customer) SELECT canonical_code, CAST(a AND b AND c AS BIGINT) AS all_of, CAST(CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 AS BIGINT) AS two_of, CAST(a AS BIGINT) AS first, CAST((a OR b) AND c AS BIGINT) AS both FROM x",
    "published_prices": f"WITH {EVENTS}, x AS (SELECT DISTINCT canonical_code, trade_date FROM events WHERE action = 'exclude_model_price') SELECT b.canonical_code, b.trade_date, {r('adjusted_close')} AS raw_adjusted_close, {r('CASE WHEN x.trade_date IS NULL THEN adjusted_close END')} AS adjusted_close FROM bars b LEFT JOIN x ON x.canonical_code = b.canonical_code AND x.trade_date = b.trade_date",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "quality_gate": f"""WITH {EVENTS}, b AS (SELECT count(DISTINCT canonical_code) AS priced, max(trade_date) AS last FROM bars),
      o AS (SELECT count(*) FILTER (WHERE bad AND trade_date >= last - 400) AS bad_now, count(*) FILTER (WHERE bad) AS bad_ever FROM (SELECT trade_date, coalesce(high < greatest(open, close), false) OR coalesce(low > least(open, close), false) OR high < low OR volume < 0 AS bad FROM bars), b),
      e AS (SELECT count(DISTINCT (source, canonical_code, trade_date)) FILTER (WHERE action = 'exclude_model_price') AS gone, count(DISTINCT (source, canonical_code, trade_date)) FILTER (WHERE action = 'exclude_model_price' AND trade_date >= last - 400) AS gone_now,
        count(*) FILTER (WHERE clean_high < clean_low) AS unclean FROM events, b),
      d AS (SELECT count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS lost FROM documents), p AS (SELECT count(*) AS unproved FROM documents x, benchmark y WHERE x.doc_id < 5 AND NOT contains({_SQ('coalesce(x.text, $$$$)')}, {_SQ('y.text')})),
      r AS (SELECT *, date_diff('day', last, DATE '2002-01-05') AS age FROM b, o, e, d, p)
      SELECT unnest(['watchlist_count', 'price_coverage', 'price_freshness_days', 'price_duplicate_keys', 'price_ohlc_valid', 'price_historical_ohlc_anomalies', 'price_source_model_exclusions', 'price_recent_model_exclusions', 'price_cleaned_ohlc_valid', 'rank_coverage', 'rank_values_valid',
          'explanation_json_valid', 'financial_coverage', 'tdnet_document_integrity', 'tdnet_pending_retries', 'qualitative_evidence_integrity', 'qualitative_coverage']) AS check_name,
        unnest(['FAIL', CASE WHEN priced / 25.0 >= 0.98 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN age <= 7 THEN 'PASS' ELSE 'FAIL' END, 'PASS', if(bad_now = 0, 'PASS', 'FAIL'), if(bad_ever = 0, 'PASS', 'WARN'), if(gone = 0, 'PASS', 'WARN'), if(gone_now = 0, 'PASS', 'WARN'), if(unclean = 0, 'PASS', 'FAIL'), 'PASS', 'PASS',
          'FAIL', 'PASS', if(lost = 0, 'PASS', 'FAIL'), 'WARN', if(unproved = 0, 'PASS', 'FAIL'), 'PASS']) AS status,
        unnest(['25', printf('%.4f', priced / 25.0), age || '', '0', bad_now || '', bad_ever || '', gone || '', gone_now || '', unclean || '', '25', '0', '1', '0.8800', lost || '', '2', unproved || '', '0.8400']) AS observed_value FROM r""",
    "incremental_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
