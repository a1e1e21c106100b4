"""WARC derivatives: metadata and plain-text conversion records of responses (operator 3).

Column expressions only: one scan, no shuffle. Each response gives two records
that refer to it by its record id and to each other, and keep its target, date,
payload digest and HTTP headers. `read_responses` parses stored WARC files member
by member; `write_records` writes records as gzip members of a table, and
`write_warc` as WARC files, one a task.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that are not text and how many of them (from the first) are common, elements that end a line, and character references, in the order of replacement.
SILENT = ("script", "style", "head", "noscript", "template")
COMMON = 3
BLOCK = "p|div|br|li|ul|ol|tr|table|h[1-6]|nav|article|section|header|footer|blockquote|pre|title|body|html"
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
DATE = "1970-01-01T00:00:00Z"


def record_id(*parts: Column) -> Column:
    """A URN that depends on the parts only."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _without_silent(html: Column, name: str) -> Column:
    if name == "head":  # the first head only, if it is closed
        return F.regexp_replace(html, r"(?is)\A((?>.*?(?=<head[\s>])))<head(?:\s[^<>]*)?>.*?</head\s*>", "$1")
    return F.regexp_replace(html, rf"(?is)<{name}(?:\s[^<>]*)?>.*?(?:</{name}\s*>|\z)", "")


def body_text(html: Column) -> Column:
    """What is left without comments and the common silent elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    for name in SILENT[:COMMON]:
        out = _without_silent(out, name)
    return out


def plain_text(body: Column) -> Column:
    """The visible text of a `body_text`: other silent elements and tags go, blocks end lines, references are read, blanks collapse.

    A comment or silent element that is not closed goes on to the end, but an
    unclosed head is only a tag. Tags hold no `<`. Every step is one pass. The
    body should be a column by name, as it is read more than once: few bodies have
    other silent elements, and those without are spared the passes.
    """
    lower, rare = F.lower(body), SILENT[COMMON:]
    out = body
    for name in rare:
        out = _without_silent(out, name)
    out = F.when(reduce(or_, [F.contains(lower, F.lit(f"<{name}")) for name in rare]), out).otherwise(body)
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK})(?:\s[^<>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[^<>]*>", "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def field(value: Column) -> Column:
    """A value on one line: control characters and line ends become blanks, so that no value begins another field."""
    return F.trim(F.regexp_replace(value, r"[\x00-\x20\x7F\x{85}\x{2028}\x{2029}]+", " "))


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (record_id, target_uri, date, http_headers, payload) of a table of pages."""
    html = F.col("html")
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), F.col("url"), html).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("Content-Type: text/html; charset=utf-8").alias("http_headers"),
        html.alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records of each response, and its columns `keep`.

    Columns: record_type, record_id, refers_to, concurrent_to (the record id of the
    other record of the response), target_uri, date, content_type, content_length
    (bytes of the block), block_digest, payload_digest, source_headers, block. The
    payload digest is the response's own where it has a column payload_digest that
    isn't null, else that of its payload in UTF-8. A null payload counts as empty:
    the metadata says so and the conversion's block is empty. A null target stays
    null. Repeated responses give repeated records; no rows give none.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    if "payload_digest" in responses.columns:
        digest = F.coalesce(F.col("payload_digest"), digest)
    size = F.col("payload_bytes") if "payload_bytes" in responses.columns else F.lit(None).cast("long")
    source = responses.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), digest.alias("payload_digest"), payload.alias("payload"), body_text(payload).alias("body"), F.coalesce(size, F.octet_length(payload)).alias("size"))
    text = plain_text(F.col("body"))
    title = field(F.regexp_extract(F.col("payload"), r"(?is)\A(?>.*?<title[^<>]*>)(.*?)</title>", 1))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("source-bytes: "), F.col("size").cast("string")),
        F.concat(F.lit("links: "), ((F.length("payload") - F.length(F.regexp_replace("payload", r"(?i)<a\s", ""))) / 3).cast("int").cast("string")),
        F.lit(""),
    )
    record = lambda kind, other, content, block: F.struct(F.lit(kind).alias("type"), F.lit(other).alias("other"), F.lit(content).alias("content"), block.alias("block"))
    both = source.select(
        *keep,
        "refers_to",
        "target_uri",
        "date",
        "source_headers",
        "payload_digest",
        F.explode(F.array(record("metadata", "conversion", "application/warc-fields", fields), record("conversion", "metadata", "text/plain; charset=utf-8", text))).alias("r"),
    )
    return both.select(
        *keep,
        F.col("r.type").alias("record_type"),
        record_id(F.col("r.type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        record_id(F.col("r.other"), F.col("refers_to")).alias("concurrent_to"),
        "target_uri",
        "date",
        F.col("r.content").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("r.block", 256)).alias("block_digest"),
        "payload_digest",
        "source_headers",
        F.col("r.block").alias("block"),
    )


def _members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each on its own; a damaged member ends the file. An uncompressed file is one."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = memoryview(raw)
    while at[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        try:
            out = reader.decompress(at)
        except zlib.error:
            return
        yield out
        at = memoryview(reader.unused_data)


def _parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file, whether compressed or not.

    A record whose length is missing, no number or beyond the data is left out, and
    reading goes on at the next record.
    """
    for data in _members(raw):
        at = 0
        while (begin := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", begin)) >= 0:
            lines = data[begin:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            length = headers.get("content-length", "")
            if not (length.isascii() and length.isdigit() and len(length) < 16 and end + 4 + int(length) <= len(data)):
                at = begin + 5
                continue
            at = end + 4 + int(length)
            yield headers, data[end + 4 : at]


def _unchunked(body: bytes) -> bytes:
    """A body without its chunk headers; what isn't well formed stays as it is from there."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join([*out, body[at:]])


def _plain_body(head: str, body: bytes) -> str:
    """The text of an HTTP body, its transfer and content encodings undone where they are well formed."""
    if re.search(r"(?im)^transfer-encoding:.*\bchunked\b", head):
        body = _unchunked(body)
    coding = re.search(r"(?im)^content-encoding:\s*(x-)?(gzip|deflate)\b", head)
    for bits in (31,) if coding and coding[2].lower() == "gzip" else (15, -15) if coding else ():
        try:
            body = zlib.decompressobj(bits).decompress(body)
            break
        except zlib.error:
            continue
    found = re.search(r"(?i)charset=[\"']?([\w.:-]+)", head)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, payload_bytes long"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses of the WARC files under `path`, read by Spark, one file a row; other record types are left out.

    payload_digest is the record's own, or that of the payload's bytes as stored if
    it has none; payload_bytes counts these bytes. A task holds one compressed file
    and one of its members.
    """
    names = [x.split()[0] for x in RESPONSE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                out: list[tuple] = []
                size = 0
                for headers, block in _parsed(raw.as_py()):
                    if headers.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = headers.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
                        lines = head.decode("latin-1")
                        out.append((headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), lines, _plain_body(lines, body), digest, len(body)))
                        size += len(block)
                    if size > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out]) for i in range(len(names))], names=names)
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if n == "payload_bytes" else pa.string()) for i, n in enumerate(names)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, RESPONSE)


def _raw(records: DataFrame) -> DataFrame:
    """(raw) each record in WARC 1.1 form, without the two line ends after its block."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), field(value), F.lit("\r\n")), F.lit(""))
    source = F.regexp_replace("source_headers", r"[\r\n]+", " | ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("X-Source-Headers", source),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n"),
    )
    return records.select(F.concat(head, F.col("block")).alias("raw"))


def serialised(records: DataFrame) -> DataFrame:
    """(record) bytes of each record in WARC 1.1 form, as one gzip member each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x.as_py().encode() + b"\r\n\r\n", 6, mtime=0) for x in batch.column(0)], pa.binary())], names=["record"])

    return _raw(records).mapInArrow(packed, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records under `path` as gzipped WARC files, one a task; a record ends with the two line ends that part records."""
    _raw(records).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Write records under `path` as a table of gzip members; the members of a part, in order, are a WARC file."""
    serialised(records).write.mode("overwrite").parquet(path)


#: The rows of derive(responses_of_pages(pages), ("page_id",)) in DuckDB's SQL.
def oracle_sql() -> str:
    text = r"regexp_replace(h, '<!--.*?(?:-->|\z)', '', 'gs')"
    for name in SILENT:
        close, every = (rf"</{name}\s*>", "") if name == "head" else (rf"(?:</{name}\s*>|\z)", "g")
        text = rf"regexp_replace({text}, '<{name}(?:\s[^<>]*)?>.*?{close}', '', '{every}is')"
    text = rf"regexp_replace({text}, '</?(?:{BLOCK})(?:\s[^<>]*)?/?>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[^<>]*>', '', 'g')"
    for name, char in REFERENCES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g')"
    urn = lambda x: f"('<urn:uuid:' || {x}[1:8] || '-' || {x}[9:12] || '-' || {x}[13:16] || '-' || {x}[17:20] || '-' || {x}[21:32] || '>')"
    crlf = "chr(13) || chr(10)"
    return rf"""
WITH source AS (
  SELECT page_id, url, coalesce(html, '') AS h,
         sha256('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')) AS s
  FROM pages
), referred AS (
  SELECT page_id, url, h, {urn("s")} AS refers_to FROM source
), both_types AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || trim(regexp_replace(regexp_extract(h, '<title[^<>]*>(.*?)</title>', 1, 'is'), '[\x00-\x20\x7F]+', ' ', 'g')) || {crlf} || 'source-bytes: ' || strlen(h) || {crlf} ||
         'links: ' || len(regexp_extract_all(h, '<a\s', 0, 'i')) || {crlf} AS block FROM referred
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM referred
), named AS (
  SELECT *, sha256(record_type || chr(10) || refers_to) AS s,
         sha256(CASE record_type WHEN 'metadata' THEN 'conversion' ELSE 'metadata' END || chr(10) || refers_to) AS c FROM both_types
)
SELECT page_id, record_type, {urn("s")} AS record_id, refers_to, {urn("c")} AS concurrent_to, url AS target_uri, '{DATE}' AS date, content_type,
       strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(h) AS payload_digest,
       'Content-Type: text/html; charset=utf-8' AS source_headers, block
FROM named
"""
