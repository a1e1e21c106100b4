"""Sources: format sniffing, JSON lists, CSV and text lines, page snapshots, and row normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields under which feeds nest their rows, and the fields that hold a row's text, by precedence.
LIST_FIELDS = ("data", "items", "results", "urls", "indicators")
TEXT_FIELDS = ("content_text", "clean_text", "text", "body", "indicator", "title")


def sniff(body: Column, content_type: Column) -> Column:
    """html, json, jsonl, csv or txt from the content type and the first characters."""
    head, kind = F.ltrim(body), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(kind.contains("html") | head.rlike(r"(?i)^<(!doctype|html)"), "html")
        .when(kind.contains("ndjson") | head.rlike(r"^\{[^\n]*\}\s*\n\s*\{"), "jsonl")
        .when(kind.contains("json") | head.rlike(r"^[\[{]"), "json")
        .when(kind.contains("csv") | head.rlike(r"^[^\n,]+(,[^\n,]+)+\n"), "csv")
        .otherwise("txt")
    )


def json_rows(df: DataFrame, column: str) -> DataFrame:
    """One row per element of a root list, or of the first list under a known field, or the object itself."""
    as_list = lambda path: F.from_json(F.get_json_object(column, path), "array<string>")
    found = F.coalesce(as_list("$"), *[as_list(f"$.{f}") for f in LIST_FIELDS], F.array(column))
    return df.withColumn("row", F.explode(found))


def data_lines(df: DataFrame, column: str) -> DataFrame:
    """One row per line that is neither blank nor a comment."""
    lines = df.withColumn("line", F.explode(F.split(column, r"\r?\n")))
    return lines.withColumn("line", F.trim("line")).where("line <> '' AND NOT line LIKE '#%' AND NOT line LIKE '//%'")


def csv_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed fields of each data line."""
    return data_lines(df, column).withColumn("row", F.from_csv("line", schema))


def row_text(row: Column) -> Column:
    """The first non-empty text field of a JSON object, else the object."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(row, f"$.{f}")), F.lit("")) for f in TEXT_FIELDS], row)


def access_type(legal_basis: Column, host: Column) -> Column:
    basis = F.lower(F.coalesce(legal_basis, F.lit("")))
    return F.when(basis.contains("partner"), "partner").when(basis.contains("authori"), "authorized").when(host.rlike(r"(^|\.)(example|test|invalid)\."), "synthetic").when(basis.contains("public"), "public").otherwise("unknown")


def failure_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("timed? ?out"), "timeout").when(m.rlike("40[13]|forbidden|unauthori"), "denied").when(m.rlike("429|rate"), "rate_limited").when(m.rlike("50[0-9]"), "server_error").when(m.rlike("parse|decode|json"), "parse_error").otherwise("other")


class _Snapshot(HTMLParser):
    SILENT = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.words, self.silent, self.in_title = [], [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in self.SILENT
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in self.SILENT))
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.words += data.split()


def snapshots(pages: DataFrame) -> DataFrame:
    """page_id, title, text: what a reader sees of each page; null pages are empty."""
    dtype = pages.schema["page_id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for html in batch.column(1).to_pylist():
                parser = _Snapshot()
                parser.feed(html or "")
                parser.close()
                titles.append(" ".join("".join(parser.title).split()))
                texts.append(" ".join(parser.words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["page_id", "title", "text"])

    return pages.select("page_id", "html").mapInArrow(parsed, f"page_id {dtype}, title string, text string")
