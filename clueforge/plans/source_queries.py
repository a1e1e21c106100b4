"""Source and parsing queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import domains as D
from clueforge.plans.relational_queries import _q
from clueforge.registry import register
from clueforge.session import table
from clueforge.sources import blocks, multimodal
from clueforge.sources import parsing as P


@register("src_sniff", r"""SELECT page_id, CASE WHEN regexp_matches(ltrim(html), '(?i)^<(!doctype|html)') THEN 'html' WHEN regexp_matches(ltrim(html), '^[\[{]') THEN 'json' ELSE 'txt' END AS format FROM pages""")
def src_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.sniff(F.col("html"), F.lit(None).cast("string")).alias("format"))


@register("src_json_list", "SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS row FROM events")
def src_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"items":[{"k":'), F.get_json_object("props", "$.k"), F.lit("}]}")).alias("body"))
    return P.json_rows(feed, "body").select("event_id", "row")


@register("src_txt", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r?\n'))) AS line FROM documents) WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%' GROUP BY 1")
def src_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.data_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("src_csv", "SELECT s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_csv(F.struct("s_name", "s_nationkey")).alias("body"))
    return P.csv_rows(lines, "body", "name string, nation int").select("s_suppkey", "row.name", "row.nation")


@register("src_html_text")
def src_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.snapshots(table(spark, sf_dir, "pages"))


@register("src_normalize_row", "SELECT conv_id, turn, text AS content FROM conversations")
def src_normalize_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.lit("").alias("content_text"), "text")).alias("row"))
    return rows.select("conv_id", "turn", P.row_text(F.col("row")).alias("content"))


@register("src_access_type", "SELECT page_id, CASE WHEN regexp_matches(url, '[./]example[.]') THEN 'synthetic' ELSE 'unknown' END AS access FROM pages")
def src_access_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", P.access_type(F.lit(None).cast("string"), host).alias("access"))


#: Suffixes under which hosts are registered, and hosts that name no one; the first part of an address's path stands for its source.
_PUBLIC, _DENIED = ("com", "net", "org", "example.com", "example.net", "example.org"), ("thther.example.org", "blog.tionsh.example.net", "ththth.example.net")
_host = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@|:[0-9]*$', '', 'g')"


@_q("agg_shared_domain", rf"""WITH h AS (SELECT page_id, regexp_replace({_host}, '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS source FROM pages),
r AS (SELECT page_id, source, regexp_extract(host, '([^.]+\.(example\.(com|net|org)))$', 1) AS domain FROM h WHERE NOT ({" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in _DENIED)}))
SELECT domain, count(DISTINCT source) AS n_sources, count(DISTINCT page_id) AS n_traces, min(page_id) AS first_trace FROM r WHERE domain <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 2""")
def _(t):
    rows = t("pages").select(D.host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("source"), F.col("page_id").alias("trace_id"))
    return D.shared_domains(rows, D.domain_matcher(t("pages").sparkSession, _PUBLIC, _DENIED))


_normal = lambda c: rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'), '[\s\x{{A0}}\x{{85}}]+', ' ', 'g'))"
_parts = f"[nullif({_normal('text')}, ''), nullif({_normal('role')}, ''), nullif({_normal('text[1:20]')}, ''), nullif({_normal('role')}, '')]"


#: Turns as records: attachments nested four deep, and a fifth level that is left out.
@_q("src_multimodal", f"""SELECT conv_id || ':' || turn AS id, array_to_string(list_filter({_parts}, lambda x: x IS NOT NULL), ' ') AS content_text,
  array_to_string(list_filter([CASE WHEN {_normal('role')} <> '' THEN 'attachments.caption' END, CASE WHEN {_normal('text[1:20]')} <> '' THEN 'attachments.media.images.alt_text' END, 'attachments.media.images.frames.cards', CASE WHEN {_normal('role')} <> '' THEN 'attachments.media.images.frames.text' END, CASE WHEN {_normal('text')} <> '' THEN 'text' END], lambda x: x IS NOT NULL), ',') AS sources,
  'attachments.media.image_url,attachments.media.images.frames.cards' AS refs, CASE WHEN {_normal('role')} <> '' THEN 0.9::DOUBLE END AS confidence, CASE WHEN {_normal('text')} <> '' THEN 'mixed' ELSE 'image_text' END AS modality FROM conversations""")
def _(t):
    one = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    frames = F.array(one(text=F.col("role"), cards=F.array(one(text=F.col("text")))))
    media = one(image_url=F.lit("https://pictures.example.com/1"), images=F.array(one(alt_text=F.substring("text", 1, 20), frames=frames)))
    record = F.to_json(one(text=F.col("text"), attachments=F.array(one(caption=F.col("role"), ocr_confidence=F.lit("90%"), media=media))))
    found = multimodal.folded(t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), record.alias("json")))
    return found.select("id", "content_text", F.array_join("sources", ",").alias("sources"), F.array_join("references", ",").alias("refs"), "confidence", "modality")


@_q("src_public_channel", None)
def _(t):
    return blocks.blocks_of(t("pages")).where("words > 0").select("page_id", "block", "parent", "depth", "tag", "words", "text")
