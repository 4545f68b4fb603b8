"""Saved responses of data providers, universe lists and text files as typed tables.

A response is one JSON document; its rows are objects whose fields have short names, or the long ones of an older version.
What a row lacks, and what can't be read as a number or a date, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kabunoki.functions.kit import finite

#: field: names that it has had
BARS = dict(
    trade_date="Date", code="Code", open="O Open", high="H High", low="L Low", close="C Close", volume="Vo Volume", turnover_value="Va TurnoverValue", adjustment_factor="AdjFactor AdjustmentFactor",
    adjusted_open="AdjO AdjustmentOpen", adjusted_high="AdjH AdjustmentHigh", adjusted_low="AdjL AdjustmentLow", adjusted_close="AdjC AdjustmentClose", adjusted_volume="AdjVo AdjustmentVolume",
)
FILINGS = dict(
    disclosure_date="DiscDate", disclosure_time="DiscTime", code="Code", disclosure_number="DiscNo", document_type="DocType", current_period_type="CurPerType", current_period_start="CurPerSt",
    current_period_end="CurPerEn", current_fiscal_year_start="CurFYSt", current_fiscal_year_end="CurFYEn", sales="Sales", operating_profit="OP", ordinary_profit="OdP", net_income="NP", eps="EPS", total_assets="TA",
    equity="Eq", equity_ratio="EqAR", bps="BPS", cash_flow_operating="CFO", cash_flow_investing="CFI", cash_flow_financing="CFF", cash_and_equivalents="CashEq", forecast_sales="FSales",
    forecast_operating_profit="FOP", forecast_ordinary_profit="FOdP", forecast_net_income="FNP", forecast_eps="FEPS", shares_outstanding="ShOutFY", roe="ROE",
)
DOCUMENTS = dict(
    document_id="docID", edinet_code="edinetCode", security_code="secCode", filer_name="filerName", description="docDescription", submitted_at="submitDateTime", document_type_code="docTypeCode",
    period_start="periodStart", period_end="periodEnd",
)
UNIVERSE = dict(
    as_of_date="日付", code="コード", company_name="銘柄名", market_segment="市場・商品区分", sector33_code="33業種コード", sector33_name="33業種区分", sector17_code="17業種コード",
    sector17_name="17業種区分", size_code="規模コード", size_name="規模区分",
)
_TEXTS = set("code disclosure_time disclosure_number document_type current_period_type".split()) | set(DOCUMENTS) - {"submitted_at", "period_start", "period_end"}


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(content, path, retrieved_at) of saved files, each whole."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("retrieved_at"))


def day(text: Column) -> Column:
    return F.coalesce(text.try_cast("date"), F.try_to_date(text, "yyyyMMdd"))


def _rows(saved: DataFrame, lists: tuple[str, ...], fields: dict[str, str], source: str) -> DataFrame:
    schema = ", ".join(f"{name} array<map<string,string>>" for name in lists)
    body = F.from_json("content", schema)
    some = F.coalesce(*[F.when(F.size(body[name]) > 0, body[name]) for name in lists])
    out = {}
    for name, had in fields.items():
        value = F.coalesce(*[F.col("_row")[x] for x in had.split()])
        if name in _TEXTS:
            out[name] = value
        elif name.endswith(("_date", "_start", "_end")):
            out[name] = day(value)
        elif name == "submitted_at":
            out[name] = F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm")), value.try_cast("timestamp")).cast("timestamp_ntz")
        else:
            out[name] = finite(value.try_cast("double"))
    rows = saved.select("retrieved_at", F.explode(some).alias("_row"))
    return rows.select(*[c.alias(name) for name, c in out.items()], F.lit(source).alias("source"), "retrieved_at")


def bars(saved: DataFrame) -> DataFrame:
    """Daily bars of saved responses (content, retrieved_at), under the fields' short names or long ones."""
    return _rows(saved, ("data", "daily_quotes"), BARS, "jquants_v2")


def filings(saved: DataFrame) -> DataFrame:
    """Summaries of financial statements."""
    return _rows(saved, ("data",), FILINGS, "jquants_v2")


def filing_query(code: str | None = None, date: str | None = None) -> dict[str, str]:
    """What to ask the provider for: the filings of a code or of a day, not both and not neither."""
    if bool(code) == bool(date):
        raise ValueError("exactly one of a code and a date")
    return {"date": "".join(c for c in str(date) if c != "-")} if date else {"code": code}


def documents(saved: DataFrame) -> DataFrame:
    """The list of documents that companies filed on a day."""
    return _rows(saved, ("results",), DOCUMENTS, "edinet_v2")


def universe(listing: DataFrame, retrieved_at: Column) -> DataFrame:
    """A list of securities under its Japanese headings as the universe table; all of it is text."""
    have = {c.strip(): c for c in listing.columns}
    columns = [(F.col(f"`{have[jp]}`") if jp in have else F.lit(None)).cast("string").alias(name) for name, jp in UNIVERSE.items()]
    return listing.select(*columns).withColumns({"code": F.trim("code"), "source": F.lit("jpx"), "retrieved_at": retrieved_at})


def texts(saved: DataFrame, code: str, disclosed: str, title: str, url: str, kind: str = "earnings_release", source: str = "manual") -> DataFrame:
    """Text files as disclosure texts, each named by its source, code, day and the beginning of its hash."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    return saved.select(
        F.concat_ws(":", F.lit(source), F.lit(code), F.lit(disclosed), F.substring(digest, 1, 16)).alias("document_id"), F.lit(code.strip().removesuffix(".T")).alias("canonical_code"),
        F.lit(disclosed).cast("date").alias("disclosure_date"), F.lit(None).cast("string").alias("disclosure_time"), F.lit(title).alias("title"), F.lit(kind).alias("document_type"), F.lit(source).alias("source"),
        F.lit(url).alias("source_url"), F.col("path").alias("raw_path"), digest.alias("content_hash"), F.col("content").alias("text_content"), "retrieved_at",
    )


def write_csv(frame: DataFrame, path: str, mark: bool = False) -> None:
    """One CSV file with a header in a folder; ``mark`` puts a byte-order mark before it, as spreadsheets like."""
    out = frame.withColumnRenamed(frame.columns[0], "﻿" + frame.columns[0]) if mark else frame
    out.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header (and a byte-order mark or not), typed by a schema in the order of its columns."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)


def register(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a view of the session, for SQL."""
    frame.createOrReplaceTempView(name)
    return frame.sparkSession.table(name)
