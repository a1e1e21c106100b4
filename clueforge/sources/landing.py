"""Landed files in and out: JSON lines, search pages, hydrated snippets, delivery exports and keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/clueforge/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "bad_line") -> DataFrame:
    """Records of JSON lines by a schema; a malformed line is a row of nulls that keeps the line in column `bad`."""
    return spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def export(df: DataFrame, path: str, form: str) -> None:
    """A delivery as jsonl, csv (with a header) or parquet."""
    writer = df.write.mode("overwrite")
    {"jsonl": writer.json, "csv": lambda p: writer.option("header", True).option("escape", '"').csv(p), "parquet": writer.parquet}[form](path)


def upsert_table(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Merge rows into a keyed table of versions under `path`: the row of highest `order` wins; returns the new version.

    A version is written whole beside the last one, so a lost task or a repeated
    batch leaves the table as it was.
    """
    from clueforge.operators.relational import latest

    spark = batch.sparkSession
    target = f"{path}/{uuid.uuid4().hex}"
    marks = f"{path}/versions"
    try:
        last = spark.read.parquet(marks).orderBy(F.desc("n")).first()
    except Exception as error:  # noqa: BLE001  the first version has none before it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    rows = batch if last is None else spark.read.schema(batch.schema).parquet(last["place"]).unionByName(batch)
    merged = latest(rows.withColumn("_key", F.struct(*keys)), "_key", order).drop("_key")
    merged.select(*batch.columns).write.parquet(target)
    spark.createDataFrame([((last["n"] if last else 0) + 1, target)], "n long, place string").coalesce(1).write.mode("append").parquet(marks)
    return spark.read.schema(batch.schema).parquet(target)


class _Results(HTMLParser):
    """Links of a result page, each with the text up to the next one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.silent = 0
        self.inside = False

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        self.silent += tag in ("script", "style")
        url = dict(attrs).get("href") or ""
        if tag == "a" and url.startswith(("http://", "https://", "/")):
            self.found.append([url, "", ""])
            self.inside = True

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        self.silent -= tag in ("script", "style") and self.silent > 0
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if self.found and not self.silent:
            self.found[-1][1 if self.inside else 2] += data


def search_results(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, position, url, title, snippet of each titled link of a page; the first of equal addresses stays. Null and empty pages have none."""
    key = pages.schema[page_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser, seen = _Results(), set()
                parser.feed(body or "")
                parser.close()
                for url, title, snippet in parser.found:
                    title, snippet = " ".join(title.split()), " ".join(snippet.split())
                    if title and url not in seen:
                        seen.add(url)
                        rows.append((page, len(seen), url, title, snippet))
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["page_id", "position", "url", "title", "snippet"])

    return pages.select(page_id, html).mapInArrow(split, f"page_id {key}, position int, url string, title string, snippet string")


def hydrate(results: DataFrame, fetched: DataFrame, least: int = 40) -> DataFrame:
    """Search results (url, snippet) with their page's text (url, body, status) instead of the snippet where it was fetched and is long enough; adds content_text and hydration."""
    one = fetched.groupBy("url").agg(F.max_by(F.struct("body", "status"), F.struct("status", "body")).alias("page"))
    df = results.join(one, "url", "left")
    state = F.when(F.col("page").isNull(), "not_fetched").when(F.col("page.status") != 200, "fetch_failed").when(F.length(F.trim(F.coalesce("page.body", F.lit("")))) < least, "too_short").otherwise("hydrated")
    return df.withColumn("hydration", state).withColumn("content_text", F.when(F.col("hydration") == "hydrated", F.trim("page.body")).otherwise(F.col("snippet"))).drop("page")
