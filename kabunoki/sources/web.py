"""Text and links out of HTML, and normalised bars out of wide downloads."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabunoki.functions.kit import canonical_code, tokyo_to_utc
from kabunoki.operators.documents import title_class
from kabunoki.session import ship

#: Elements before which a line breaks, and those after which it does too.
BREAKS = frozenset("p div br tr li h1 h2 h3".split())
CLOSES = frozenset("p div tr li".split())
HIDDEN = frozenset(("script", "style"))
LONGEST = 300_000
EMPTY = re.compile("\n\n\n+")
#: The columns of a disclosure list, by the class of its cells.
CELLS = dict(zip("kjTime|kjCode|kjName|kjTitle|kjXbrl|kjPlace|kjHistroy".split("|"), "disclosure_time|tdnet_code|company_name|title|xbrl|exchange|update_history".split("|")))
DISCLOSURES = "disclosure_time string, tdnet_code string, company_name string, title string, pdf_href string, xbrl_href string, exchange string, update_history string"


class _Visible(HTMLParser):
    """Collects the data outside hidden elements, with a line break where a block begins or ends."""

    depth = 0

    def reset(self) -> None:
        HTMLParser.reset(self)
        self.out, self.depth = [], 0

    def _edge(self, tag: str, step: int, breaks: frozenset[str]) -> None:
        if tag in HIDDEN:
            self.depth = max(0, self.depth + step)
        elif tag in breaks:
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._edge(tag, 1, BREAKS)

    def handle_endtag(self, tag: str) -> None:
        self._edge(tag, -1, CLOSES)

    def handle_data(self, data: str) -> None:
        self.out += [] if self.depth else [data]


def visible(html: str | None) -> str | None:
    """What a reader sees: no scripts or styles, blocks on lines of their own, at most one empty line in a row, no more
    than LONGEST characters."""
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    text = EMPTY.sub("\n" * 2, "".join(parser.out))
    return text.strip()[:LONGEST]


class _Rows(HTMLParser):
    """Collects the rows of a disclosure list that have a code and a document."""

    def reset(self) -> None:
        HTMLParser.reset(self)
        self.rows, self.text = [], []
        self.row = self.field = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "tr":
            self.row = {}
        elif self.row is not None and tag == "td":
            classes = given.get("class", "").split()
            self.field, self.text = next((name for c, name in CELLS.items() if c in classes), None), []
        elif self.row is not None and tag == "a" and given.get("href") and self.field in ("title", "xbrl"):
            self.row["pdf_href" if self.field == "title" else "xbrl_href"] = given["href"]

    def handle_data(self, data: str) -> None:
        self.text += [data] if self.field else []

    def handle_endtag(self, tag: str) -> None:
        if self.row is not None and tag == "td" and self.field:
            self.row[self.field] = " ".join("".join(self.text).split())
            self.field = None
        elif self.row is not None and tag == "tr":
            if self.row.get("tdnet_code") and self.row.get("pdf_href"):
                self.rows.append(self.row)
            self.row = None


def disclosure_rows(html: str | None) -> list[dict]:
    """The items of one page of a disclosure list; what a row lacks is empty, but for the link to figures, which is null."""
    parser = _Rows()
    parser.feed(html or "")
    names = [c.split()[0] for c in DISCLOSURES.split(", ")]
    return [{n: r.get(n, None if n == "xbrl_href" else "") for n in names} for r in parser.rows]


def disclosure_list(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` (without the HTML) with a row for each item of their lists, its canonical_code and document_id."""
    ship(pages.sparkSession)
    items = F.pandas_udf(_rows_series, f"array<struct<{DISCLOSURES.replace(' string', ':string')}>>")
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(items(F.col(html))).alias("_i")).select("*", "_i.*").drop("_i")
    stem = F.regexp_extract("pdf_href", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return rows.withColumns({"canonical_code": canonical_code(F.col("tdnet_code")), "document_id": F.concat(F.lit("tdnet:"), stem)})


def _rows_series(s: pd.Series) -> pd.Series:
    return s.map(disclosure_rows)


def list_pages(html: Column, day: str) -> Column:
    """How many pages a day's disclosure list has, by the links to them; 1 without any."""
    found = F.regexp_extract_all(html, F.lit(rf"I_list_(\d{{3}})_{day.replace('-', '')}\.html"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(1))


def select_disclosures(items: DataFrame, types: tuple[str, ...] | None = None, codes: DataFrame | None = None, code: str | None = None, limit: int | None = None) -> DataFrame:
    """Of listed items each document once, by the types of their titles and by codes, the latest first."""
    one = items.groupBy("document_id").agg(F.max(F.struct("disclosure_time", *[c for c in items.columns if c not in ("document_id", "disclosure_time")])).alias("x")).select("document_id", "x.*")
    if codes is not None:
        one = one.join(codes.select("canonical_code"), "canonical_code", "left_semi")
    if code is not None:
        one = one.where(F.col("canonical_code") == canonical_code(F.lit(code)))
    if types is not None:
        one = one.where(title_class(F.col("title")).isin(*types))
    out = one.orderBy(F.desc("disclosure_time"), F.desc("document_id"))
    return out.limit(limit) if limit is not None else out


def visible_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``visible_text``. An HTML parser has no equivalent in columns; batches come and go by Arrow."""
    ship(pages.sparkSession)
    return pages.withColumn("visible_text", F.pandas_udf(_visible_series, "string")(F.col(html)))


def _visible_series(s: pd.Series) -> pd.Series:
    return s.map(visible)


def page_numbers(html: Column, pattern: str = r"[?&]page=(\d+)") -> Column:
    """The greatest page number that links name; 1 without any."""
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return F.greatest(F.coalesce(F.array_max(found), F.lit(1)), F.lit(1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def long_bars(wide: DataFrame, symbols: list[str], source: str = "quotes") -> DataFrame:
    """Rows per day with columns "<Field> <SYMBOL>" as one row per day and symbol; a close is known at 15:30 in Tokyo."""
    fields = dict(zip("Open|High|Low|Close|Adj Close|Volume".split("|"), "open|high|low|close|adjusted_close|volume".split("|")))
    rows = [F.struct(F.lit(s.removesuffix(".T")).alias("canonical_code"), *[(F.col(f"`{f} {s}`") if f"{f} {s}" in wide.columns else F.lit(None)).cast("double").alias(n) for f, n in fields.items()]) for s in symbols]
    out = wide.select(F.col("Date").cast("date").alias("trade_date"), F.explode(F.array(*rows)).alias("b")).select("trade_date", "b.*").where("close IS NOT NULL")
    return out.withColumns({"source": F.lit(source), "available_at": tokyo_to_utc(F.col("trade_date"), "15:30:00")})


def content_key(content: Column) -> Column:
    """The name under which raw content is stored once."""
    return F.sha2(content.cast("binary"), 256)
