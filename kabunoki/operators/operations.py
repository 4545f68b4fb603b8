"""Keyed writes as derivations, watermarks and catch-up, journals, the quality gate, coverage and publication inputs.

Tables are immutable sets of files: an upsert is the old rows whose key is not among the incoming ones, and the incoming
rows. The shuffle is by key, on both sides, and none if they are bucketed by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kabunoki.operators.documents import first_per_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace by key. Columns match by name; what ``new`` lacks keeps its old value. Of several incoming rows
    of a key the first in ``order`` counts; the order should be total."""
    new = first_per_key(new, keys, *order)
    lacking = [c for c in old.columns if c not in new.columns]
    if lacking:
        new = new.join(old.select(*keys, *lacking), keys, "left")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*[F.col(c).cast(old.schema[c].dataType) for c in old.columns]))


def upsert_by_position(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``upsert`` of rows whose columns match the table's by their place, whatever they are called. ``order`` is over the
    table's names."""
    if len(new.columns) != len(old.columns):
        raise ValueError(f"{len(new.columns)} columns for a table of {len(old.columns)}")
    return upsert(old, new.toDF(*old.columns), keys, order)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or ignore by key; of several incoming rows of a key the first in ``order`` counts."""
    return old.unionByName(first_per_key(new, keys, *order).join(old.select(*keys), keys, "left_anti"))


def update(table: DataFrame, where: Column, **values: Column | object) -> DataFrame:
    """``table`` with columns set to new values in the rows where the condition holds; where it is null they stay."""
    return table.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


MESSAGE = 4000  # characters of a journal's message


def journal_message(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(MESSAGE))


def start_run(runs: DataFrame, run_id: str, scheduled: str, now: Column, version: str) -> DataFrame:
    """The journal with stale runs aborted and a new one running."""
    row = {"batch_run_id": F.lit(run_id), "scheduled_date": F.lit(scheduled).cast("date"), "started_at": now, "status": F.lit("running"), "pipeline_version": F.lit(version)}
    new = runs.sparkSession.range(1).select(*[row.get(c, F.lit(None)).cast(runs.schema[c].dataType).alias(c) for c in runs.columns])
    return recover_stale(runs, now).unionByName(new)


def finish_run(runs: DataFrame, run_id: str, status: str, now: Column, message: str = "") -> DataFrame:
    return update(runs, F.col("batch_run_id") == run_id, finished_at=now, status=status, message=journal_message(F.lit(message)))


def finish_step(steps: DataFrame, run_id: str, step: str, attempt: int, status: str, now: Column, message: str = "", **counts: int) -> DataFrame:
    """The journal of steps with one attempt finished; ``counts`` are processed_count, success_count and error_count."""
    mine = (F.col("batch_run_id") == run_id) & (F.col("step_name") == step) & (F.col("attempt") == attempt)
    return update(steps, mine, finished_at=now, status=status, message=journal_message(F.lit(message)), **counts)


def watermark(marks: DataFrame, source: str, stream: str) -> str | None:
    """How far a source's stream has been read; None if it hasn't."""
    row = marks.where((F.col("source") == source) & (F.col("stream") == stream)).select("watermark_value").first()
    return row[0] if row else None


def set_watermark(marks: DataFrame, source: str, stream: str, value: str, now: Column, run_id: str | None = None) -> DataFrame:
    row = {"source": F.lit(source), "stream": F.lit(stream), "watermark_value": F.lit(value), "updated_at": now, "batch_run_id": F.lit(run_id)}
    new = marks.sparkSession.range(1).select(*[row[c].cast(marks.schema[c].dataType).alias(c) for c in marks.columns])
    return upsert(marks, new, ["source", "stream"], [F.lit(0)])


def merge_documents(old: DataFrame, new: DataFrame, keys: list[str], status: str, kept_if: Column, initial: str) -> DataFrame:
    """Merge: incoming values win, except that the status of a known row stays where ``kept_if`` (on old columns) holds."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    known, comes = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == status:
            out.append(F.when(known & (~comes | kept_if), mine).otherwise(F.lit(initial)).alias(c))
        elif c in new.columns:
            out.append(F.when(comes, theirs).otherwise(mine).alias(c))
        else:
            out.append(mine.alias(c))
    return j.select(*out)


def recover_stale(runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Runs that have been running for too long are aborted, and their message says so."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(hours=F.lit(hours)))
    return update(runs, stale, status="aborted", finished_at=now, message=F.concat(F.coalesce("message", F.lit("")), F.lit(" recovered as stale")))


def requeue(queue: DataFrame, failed: DataFrame, now: Column, action: str = "collect_document", minutes: int = 15) -> DataFrame:
    """The retry queue with one pending row, due in some minutes, for each failed item (source, item_key, error). A
    pending row of the item that is there already goes. The id is the hash of source, item and time, so a repeated job
    gives the same."""
    key = ["source", "item_key"]
    items = failed.groupBy(*key).agg(F.max("error").alias("error"))
    rest = queue.join(items.select(*key, F.lit("pending").alias("status")), [*key, "status"], "left_anti").select(*queue.columns)
    new = items.select(
        F.sha2(F.concat_ws("\n", *key, now.cast("string")), 256).alias("retry_id"), *key, F.lit(action).alias("action"), F.lit(1).alias("attempt_count"), (now + F.make_interval(mins=F.lit(minutes))).alias("next_attempt_at"),
        F.lit("pending").alias("status"), journal_message(F.col("error")).alias("last_error"), now.alias("created_at"), now.alias("updated_at"),
    )
    return rest.unionByName(new)


def resolve(queue: DataFrame, source: str, now: Column, item: str | None = None) -> DataFrame:
    """What was pending of a source (or of one of its items) is resolved, as it has succeeded."""
    done = (F.col("source") == source) & (F.col("status") == "pending")
    return update(queue, done & (F.col("item_key") == item) if item is not None else done, status="resolved", updated_at=now)


def within_horizon(watermark: Column, today: Column, days: int = 30) -> Column:
    """A watermark no older than the day before a source's horizon: older days can't be fetched any more."""
    earliest = F.date_sub(today.cast("date"), days + 1)
    return F.when(watermark.isNotNull(), F.greatest(watermark.cast("date"), earliest))


def catch_up(watermark: Column, target: Column, most: int = 7) -> Column:
    """Dates to fetch after a watermark, oldest first, at most so many; without one, the target alone."""
    mark = watermark.cast("date")
    some = F.sequence(F.date_add(mark, 1), F.least(target, F.date_add(mark, most)))
    return F.when(mark.isNull(), F.array(target)).when(mark >= target, F.array().cast("array<date>")).otherwise(some)


def fetch_window(gap_days: Column) -> Column:
    """How much history to ask for after a gap."""
    return F.when(gap_days.isNull() | (gap_days > 90), "2y").when(gap_days > 30, "3mo").otherwise("1mo")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def latest_as_of(frame: DataFrame, column: str, *where: Column) -> DataFrame:
    """The rows of the greatest value of ``column``: a one-row aggregate, joined by broadcast."""
    f = frame
    for w in where:
        f = f.where(w)
    return f.join(F.broadcast(f.agg(F.max(column).alias("_last"))), F.col(column) == F.col("_last")).drop("_last")  # one row


FINANCIAL = "銀行業|証券、商品先物取引業|保険業|その他金融業".split("|")
SIZES = "TOPIX Core30|TOPIX Large70|TOPIX Mid400".split("|")
MARKETS = "プライム（内国株式）|スタンダード（内国株式）|グロース（内国株式）".split("|")


def watchlist(universe: DataFrame, name: str = "topix500", limit: int | None = None, sizes: list[str] = SIZES, markets: list[str] = MARKETS, financial: list[str] = FINANCIAL) -> DataFrame:
    """The securities to watch: of the latest universe, the named markets and sizes, in the order of sizes, then codes."""
    u = latest_as_of(universe, "as_of_date").where(F.col("market_segment").isin(*markets) & F.col("size_name").isin(*sizes))
    place = F.array_position(F.array(*[F.lit(s) for s in sizes]), F.col("size_name"))
    # One day's universe: thousands of rows, ranked in one partition.
    u = u.withColumn("selection_rank", F.row_number().over(W.partitionBy("as_of_date").orderBy(place, "code")).cast("long"))
    if limit:
        u = u.where(F.col("selection_rank") <= limit)
    return u.select(
        F.lit(name).alias("watchlist_name"), "as_of_date", F.col("code").alias("canonical_code"), *"selection_rank size_name sector33_name market_segment company_name".split(),
        F.when(F.col("sector33_name").isin(*financial), "financial").otherwise("general").alias("model_group"),
    )


def watchlist_symbols(members: DataFrame, symbols: DataFrame, name: str, provider: str, limit: int | None = None) -> DataFrame:
    now = latest_as_of(members, "as_of_date", F.col("watchlist_name") == name)
    out = now.join(symbols.where(F.col("provider") == provider), "canonical_code").select("canonical_code", "provider_symbol", "selection_rank").orderBy("selection_rank")
    return out.limit(limit) if limit else out


def coverage(members: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Per security: bars, filing dates, documents, analyses, features and ranks there are, and two weighted shares.

    ``layers`` has price (trade_date), financial (disclosure_date), fundamental, document (disclosure_date), analysis
    (document_id, disclosure_date), qualitative and rank (qualitative_confidence), each by canonical_code."""
    by = lambda k, *a: layers[k].groupBy("canonical_code").agg(*a)
    one = F.max(F.lit(1).cast("long"))
    parts = [
        by("price", F.count(F.lit(1)).alias("price_rows"), F.min("trade_date").alias("first_price_date"), F.max("trade_date").alias("last_price_date")),
        by("financial", F.countDistinct("disclosure_date").alias("financial_periods"), F.max("disclosure_date").alias("last_financial_date")),
        by("fundamental", one.alias("fundamental_available")),
        by("document", F.count(F.lit(1)).alias("source_document_count"), F.max("disclosure_date").alias("last_source_document_date")),
        by("analysis", F.countDistinct("document_id").alias("analysis_count"), F.max("disclosure_date").alias("last_analysis_date")),
        by("qualitative", one.alias("qualitative_feature_available")),
        by("rank", one.alias("_ranked"), F.max("qualitative_confidence").alias("_confidence")),
    ]
    out = members
    for p in parts:
        out = out.join(p, "canonical_code", "left")
    counts = "price_rows financial_periods fundamental_available source_document_count analysis_count qualitative_feature_available".split()
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    flag = lambda c: c.cast("long")
    year, three, ranked = flag(F.col("price_rows") >= 252), flag(F.col("financial_periods") >= 3), flag(F.col("_ranked").isNotNull())
    return out.withColumns(
        {
            "qualitative_used_in_rank": flag(F.coalesce(F.col("_confidence"), F.lit(0.0)) > 0), "core_coverage_pct": 40 * year + 40 * three + 20 * ranked,
            "extended_coverage_pct": 25 * year + 25 * three + 15 * ranked + 15 * flag(F.col("source_document_count") > 0) + 10 * flag(F.col("analysis_count") > 0) + 10 * F.col("qualitative_feature_available"),
        }
    ).drop("_ranked", "_confidence")


def ranked_codes(inputs: DataFrame, limit: int, rank: str = "rank_6m") -> DataFrame:
    """(canonical_code, place, label) of the first securities by rank, then code."""
    one = first_per_key(inputs, ["canonical_code"], F.col(rank).asc_nulls_last(), F.col("company_name"))
    # A row per security, ranked in one partition.
    placed = one.withColumn("place", F.row_number().over(W.orderBy(F.col(rank).asc_nulls_last(), "canonical_code")).cast("long"))
    return placed.where(F.col("place") <= limit).select("canonical_code", "place", F.concat_ws(" ", "canonical_code", "company_name").alias("label"))


def disclosure_events(filings: DataFrame, codes: DataFrame, period: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Distinct (canonical_code, month, disclosure_date, current_period_type, document_type, label) of the codes'
    disclosures in a period; the label is the period's type or else the document's."""
    d = F.col("disclosure_date")
    f = filings.join(codes.select("canonical_code"), "canonical_code", "left_semi")
    for bound, holds in ((period[0], lambda x: d >= x), (period[1], lambda x: d <= x)):
        if bound:
            f = f.where(holds(F.lit(bound).cast("date")))
    kinds = ["current_period_type", "document_type"]
    return f.select("canonical_code", F.trunc("disclosure_date", "month").alias("month"), "disclosure_date", *kinds).distinct().withColumn("label", F.coalesce(*kinds).cast("string"))


def month_counts(bars: DataFrame, codes: DataFrame, period: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(canonical_code, month, bars): every month of the period, or else from the first to the last of any bar, 0 where a
    code has none."""
    start, end = (F.lit(x).cast("date") for x in period)
    limits = bars.agg(F.coalesce(start, F.min("trade_date")).alias("a"), F.coalesce(end, F.max("trade_date")).alias("b"))
    b = bars.join(codes, "canonical_code", "left_semi").crossJoin(F.broadcast(limits)).where(F.col("trade_date").between(F.col("a"), F.col("b")))  # one row
    b = b.withColumn("month", F.trunc("trade_date", "month"))
    spine = limits.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    grid = codes.select("canonical_code").crossJoin(spine.select(F.col("month").cast("date").alias("month")))
    return grid.join(b.groupBy("canonical_code", "month").agg(F.count(F.lit(1)).alias("bars")), ["canonical_code", "month"], "left").withColumn("bars", F.coalesce("bars", F.lit(0)).cast("long"))


PRICE_LAYER = "return_1m return_3m return_6m return_12m momentum_12_1 volatility_20d volatility_60d downside_volatility_60d max_drawdown_252d high_52w_distance log_average_turnover_20d".split()
FINANCIAL_LAYER = "per pbr roe equity_ratio operating_margin sales_yoy operating_profit_yoy eps_yoy forecast_eps_revision financial_completeness".split()
#: What each layer needs: all of the conditions, each so many values in some columns.
LAYERS: dict[str, list[tuple[list[str], int]]] = {
    "price_date": [(["price_date"], 1)], "disclosure_date": [(["disclosure_date"], 1)], "price_features": [(PRICE_LAYER, 3)], "financial_features": [(FINANCIAL_LAYER, 1)],
    "model_input": [(PRICE_LAYER, 3), (["financial_completeness"], 1)], "label_6m": [(["forward_return_6m"], 1)], "label_12m": [(["forward_return_12m"], 1)],
}


def has_layer(needs: list[tuple[list[str], int]]) -> Column:
    """Whether each group of columns has at least so many values."""
    return reduce(lambda a, b: a & b, [sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)) >= k for cs, k in needs])


def availability(frame: DataFrame, layers: dict[str, list[tuple[list[str], int]]] = LAYERS, keys: tuple[str, ...] = ("canonical_code",)) -> DataFrame:
    """The keys and a 0/1 column per layer."""
    return frame.select(*keys, *[has_layer(needs).cast("long").alias(name) for name, needs in layers.items()])


def availability_matrix(frame: DataFrame, layer: list[tuple[list[str], int]], names: DataFrame, order: DataFrame | None = None, limit: int | None = None, date: str = "evaluation_date") -> DataFrame:
    """(place, ticker_label, a 0/1 column per month): whether each security has a layer in each month, 0 where it has no
    row. Securities come in the order of ``order`` (canonical_code, model_rank), if given, then of codes; months are named
    YYYY-MM. ``names`` has canonical_code and company_name. One row per security and one column per month come out, and
    the months are few, so they are listed first."""
    one = names.groupBy("canonical_code").agg(F.min("company_name").alias("company_name"))
    codes = frame.select("canonical_code").distinct().join(one, "canonical_code", "left")
    place = [F.col("canonical_code")]
    if order is not None:
        codes, place = codes.join(order.select("canonical_code", "model_rank"), "canonical_code", "left"), [F.col("model_rank").asc_nulls_last(), *place]
    # A row per security, ranked in one partition.
    codes = codes.withColumn("place", F.row_number().over(W.orderBy(*place)).cast("long"))
    if limit is not None:
        codes = codes.where(F.col("place") <= limit)
    label = F.concat_ws(" ", "canonical_code", F.coalesce("company_name", F.lit("-"))).alias("ticker_label")
    cells = frame.select("canonical_code", F.date_format(date, "yyyy-MM").alias("month"), has_layer(layer).cast("long").alias("has")).join(codes.select("canonical_code", "place", label), "canonical_code")
    months = [r[0] for r in frame.select(F.date_format(date, "yyyy-MM").alias("m")).where("m IS NOT NULL").distinct().orderBy("m").collect()]
    return cells.groupBy("place", "ticker_label").pivot("month", months).agg(F.max("has")).na.fill(0, months)


def coverage_counters(coverage: DataFrame) -> DataFrame:
    """One row: how many securities there are, and how many have what the coverage report counts."""
    tests = {"price_252": "price_rows >= 252", "financial_3": "financial_periods >= 3", "core_complete": "core_coverage_pct = 100", "with_source": "source_document_count > 0", "with_analysis": "analysis_count > 0"}
    return coverage.agg(F.count(F.lit(1)).alias("securities"), *[F.count(F.when(F.expr(x), F.lit(1))).alias(name) for name, x in tests.items()])


def sector_summary(ranks: DataFrame, score: str = "score_12m") -> DataFrame:
    """(sector33_name, companies, median_score), the smallest sectors first; securities without a sector are one."""
    return ranks.groupBy("sector33_name").agg(F.count("canonical_code").alias("companies"), F.median(score).alias("median_score")).orderBy("companies", F.col("sector33_name").asc_nulls_last())


def published_prices(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with the adjusted close hidden where an event excludes the bar from models."""
    gone = events.where("action = 'exclude_model_price'").select("canonical_code", "trade_date", "source").distinct().withColumn("_gone", F.lit(True))
    return bars.join(gone, ["canonical_code", "trade_date", "source"], "left").select("canonical_code", "trade_date", F.col("adjusted_close").alias("raw_adjusted_close"), F.when(F.col("_gone").isNull(), F.col("adjusted_close")).alias("adjusted_close"))


def check(name: str, observed: Column, passed: Column, threshold: str, bad: str = "FAIL", message: str | Column = "") -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(name).alias("check_name"), F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise(bad).alias("status"), observed.cast("string").alias("observed_value"), F.lit(threshold).alias("threshold"), text.alias("message"))


def quality_gate(t: dict[str, DataFrame], today: str, watchlist_name: str = "topix500", cleaning_version: str | None = None, prompt_version: str | None = None) -> DataFrame:
    """The seventeen checks, a row each. ``t`` holds members, bars, events, ranks, filings, symbols, tdnet, texts, retries,
    analyses (evidence as an array of structs) and qualitative. Each table is aggregated to one row and the rows are
    put side by side, so a table is read once however many checks use it."""
    one = F.lit(1)
    members = latest_as_of(t["members"], "as_of_date", F.col("watchlist_name") == watchlist_name).select("canonical_code").distinct()
    size = members.agg(F.count(one).alias("n"))
    priced = t["bars"].join(members, "canonical_code", "left_semi").agg(F.countDistinct("canonical_code").alias("priced"), F.max("trade_date").alias("last"))
    dup = duplicate_keys(t["bars"], ["canonical_code", "trade_date", "source"]).agg(F.count(one).alias("dup"))
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low")) | (F.col("volume") < 0)
    recent = F.col("trade_date") >= F.date_sub(F.col("last"), 400)
    ohlc = t["bars"].join(F.broadcast(priced.select("last"))).agg(F.count(F.when(bad & recent, one)).alias("bad_now"), F.count(F.when(bad, one)).alias("bad_ever"))  # one row
    e = t["events"].where(F.col("cleaning_version") == cleaning_version) if cleaning_version else t["events"]
    key, out = F.struct("canonical_code", "trade_date", "source"), F.col("action") == "exclude_model_price"
    events = e.join(F.broadcast(priced.select("last"))).agg(
        F.countDistinct(F.when(out, key)).alias("gone"), F.countDistinct(F.when(out, F.col("canonical_code"))).alias("gone_codes"), F.countDistinct(F.when(out & recent, key)).alias("gone_now"),
        F.countDistinct(F.when(F.col("reason_code").isin("ohlc_boundary_error", "ohlc_nonpositive_or_nonfinite"), key)).alias("fixed"),
        F.count(F.when(F.col("cleaned_high") < F.col("cleaned_low"), one)).alias("unclean"),
    )
    newest = t["ranks"].agg(F.max_by(F.struct("snapshot_date", "ranking_version"), "calculated_at").alias("v"))
    kind = "array<struct<factor:string,score:double,contribution:double>>"
    r = t["ranks"].join(F.broadcast(newest)).where((F.col("snapshot_date") == F.col("v.snapshot_date")) & (F.col("ranking_version") == F.col("v.ranking_version"))).join(F.broadcast(size))  # one row each
    beyond = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    wrong = beyond("rank_6m", 1, F.col("n")) | beyond("rank_12m", 1, F.col("n")) | beyond("score_6m", 0, 100) | beyond("score_12m", 0, 100)
    unread = F.from_json("positive_reasons", kind).isNull() | F.from_json("negative_reasons", kind).isNull()
    ranks = r.agg(F.count(one).alias("ranked"), F.count(F.when(wrong, one)).alias("wrong"), F.count(F.when(unread, one)).alias("unread"))
    filed = t["filings"].join(t["symbols"].where("provider = 'jquants_v2'").select(F.col("provider_symbol").alias("code"), "canonical_code"), "code").join(members, "canonical_code", "left_semi").agg(F.countDistinct("canonical_code").alias("filed"))
    lost = F.col("pdf_path").isNull() | (F.coalesce("text_characters", F.lit(0)) == 0) | F.col("_there").isNull()
    tdnet = t["tdnet"].where("status = 'downloaded'").join(t["texts"].select("document_id", F.lit(1).alias("_there")), "document_id", "left").agg(F.count(F.when(lost, one)).alias("lost"))
    pending = t["retries"].where("source = 'tdnet' AND status = 'pending'").agg(F.count(one).alias("pending"))
    from kabunoki.operators.documents import check_evidence

    a = t["analyses"].where(F.col("prompt_version") == prompt_version) if prompt_version else t["analyses"]
    proof = check_evidence(a, t["texts"]).agg(F.coalesce(F.sum("rejected"), F.lit(0)).alias("unproved"))
    q = t["qualitative"].join(F.broadcast(newest)).where(F.col("snapshot_date") == F.col("v.snapshot_date")).agg(F.countDistinct("canonical_code").alias("judged"))
    row = size
    for x in (priced, dup, ohlc, events, ranks, filed, tdnet, pending, proof, q):
        row = row.crossJoin(x)
    n, none = F.col("n"), lambda c: F.col(c) == 0
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    age = F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("last")), F.lit(9999))
    percent = lambda c: F.format_string("%.4f", share(c))
    rows = [
        check("watchlist_count", n, n.between(450, 550), "450..550"), check("price_coverage", percent("priced"), share("priced") >= 0.98, ">=0.98"), check("price_freshness_days", age, age <= 7, "<=7"),
        check("price_duplicate_keys", F.col("dup"), none("dup"), "0"), check("price_ohlc_valid", F.col("bad_now"), none("bad_now"), "0 in the latest 400 days"),
        check("price_historical_ohlc_anomalies", F.col("bad_ever"), none("bad_ever"), "0", "WARN", "corrected or excluded when derived; sources stay as they are"),
        check("price_source_model_exclusions", F.col("gone"), none("gone"), "0", "WARN", F.concat(F.col("gone_codes").cast("string"), F.lit(" codes"))), check("price_recent_model_exclusions", F.col("gone_now"), none("gone_now"), "0 in the latest 400 days", "WARN"),
        check("price_cleaned_ohlc_valid", F.col("unclean"), none("unclean"), "0 after cleaning", "FAIL", F.concat(F.col("fixed").cast("string"), F.lit(" bars corrected"))), check("rank_coverage", F.col("ranked"), F.col("ranked") == n, "= watchlist_count"),
        check("rank_values_valid", F.col("wrong"), none("wrong"), "0"), check("explanation_json_valid", F.col("unread"), none("unread"), "0"), check("financial_coverage", percent("filed"), share("filed") >= 0.8, ">=0.80", "WARN"),
        check("tdnet_document_integrity", F.col("lost"), none("lost"), "0"), check("tdnet_pending_retries", F.col("pending"), none("pending"), "0", "WARN"), check("qualitative_evidence_integrity", F.col("unproved"), none("unproved"), "0"),
        check("qualitative_coverage", percent("judged"), share("judged") >= 0.8, ">=0.80", "WARN"),
    ]
    return row.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def gate_passes(checks: DataFrame) -> bool:
    return checks.where("status = 'FAIL'").isEmpty()
