"""Queries of further scalar functions, projections and small reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import graph as G
from clueforge.operators import relational as O
from clueforge.plans.graph_queries import ENTITIES, clues, entities, rated
from clueforge.plans.record_queries import CLASSIFIED, classified
from clueforge.plans.relational_queries import _q
from clueforge.registry import register
from clueforge.sources import parsing as P


@_q("fn_ordered_unique", "SELECT doc_id, lower(lang) || ',' || source AS value FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(T.ordered_unique(F.array("lang", F.lit(" "), F.upper("lang"), "source", F.concat(F.lit(" "), F.upper("source")))), ",").alias("value"))


@_q("fn_remove_entities", "SELECT doc_id, sha1(" + "regexp_replace(" * len(T.PII) + "text" + "".join(f", '{p}', '', 'g')" for _, p in T.SQL_PII) + ") AS value FROM documents")
def _(t):
    bare = F.col("text")
    for _, pattern in T.PII:
        bare = F.regexp_replace(bare, pattern, "")
    return t("documents").select("doc_id", F.sha1(bare).alias("value"))


@_q("fn_generic_domain", r"SELECT page_id, regexp_matches(url, '^https?://(www\.)?example\.(com|org|net)') AS generic FROM pages")
def _(t):
    return t("pages").select("page_id", T.domain_of(F.col("url")).rlike(r"^(www\.)?example\.(com|org|net)$").alias("generic"))


@_q("fn_contact_key", "SELECT c_custkey, lower(replace(c_name, '#', '')) AS contact FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.lower(F.regexp_replace(F.concat(F.lit("@"), F.replace("c_name", F.lit("#"), F.lit(""))), "^(tg:|telegram:|@)+", "")).alias("contact"))


@_q("fn_deobfuscate", "SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', '') AS domain FROM pages")
def _(t):
    hidden = F.replace(F.regexp_replace("url", "^http", "hxxp"), F.lit("."), F.lit("[.]"))
    return t("pages").select("page_id", T.domain_of(hidden).alias("domain"))


@register("fn_normalize_entity", f"WITH {ENTITIES} SELECT DISTINCT entity_type, normalized, masked FROM entities")
def fn_normalize_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("entity_type", "normalized", "masked").distinct()


@_q("fn_time_phrase", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 WHEN 2 THEN 6 END AS hours FROM events")
def _(t):
    said = F.element_at(F.array(F.lit("seen today"), F.lit("in the last 2 days"), F.lit("Last 6 hours"), F.lit("ever")), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", T.phrase_hours(said).alias("hours"))


@_q("fn_html_clean", r"SELECT page_id, sha1(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS value FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha1(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))).alias("value"))


@register("fn_fp_risk", f"WITH {ENTITIES} SELECT clue_id, false_positive_risk FROM rated")
def fn_fp_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).select("clue_id", "false_positive_risk")


@register("agg_clue_conf", f"WITH {ENTITIES} SELECT clue_id, confidence FROM clues")
def agg_clue_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clues(spark, sf_dir).select("clue_id", "confidence")


@_q("fn_prf", "SELECT lang, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 4) AS recall FROM (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def _(t):
    good, long_ = F.col("quality") == 1, F.col("n_chars") > 1000
    c = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(good & long_).cast("double").alias("tp"), F.count_if(~good & long_).alias("fp"), F.count_if(good & ~long_).alias("fn"))
    return c.select("lang", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4).alias("recall"))


@register("join_clean_back", f"WITH {CLASSIFIED} SELECT doc_id, n_chars, length(t) AS clean_chars, drop_reason FROM documents JOIN bucketed ON trace_id = doc_id")
def join_clean_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clueforge.session import table

    clean = classified(spark, sf_dir).select(F.col("trace_id").alias("doc_id"), F.length("clean_text").cast("long").alias("clean_chars"), "drop_reason")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(clean, "doc_id")


@register("join_clue_evidence", f"WITH {ENTITIES} SELECT clue_id, count(DISTINCT trace_id) AS evidence FROM clues c JOIN (SELECT entity_type, normalized, trace_id FROM entities) e ON c.entity_type = e.entity_type AND c.key = e.normalized GROUP BY 1")
def join_clue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = entities(spark, sf_dir).select("entity_type", F.col("normalized").alias("key"), "trace_id")
    return clues(spark, sf_dir).select("clue_id", "entity_type", "key").join(keyed, ["entity_type", "key"]).groupBy("clue_id").agg(F.countDistinct("trace_id").alias("evidence"))


@register("join_cooccur", f"WITH {ENTITIES} SELECT trace_id, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM entities GROUP BY 1 HAVING count(*) > 1")
def join_cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = entities(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("n")).where("n > 1")
    return per.select("trace_id", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))


@_q("lim_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 7")
def _(t):
    return t("documents").select("doc_id").orderBy("doc_id").limit(7)


@_q("set_dedupe_id", "SELECT conv_id, min(turn) AS first_turn FROM conversations GROUP BY 1")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))


@register("dom_graph_recent", f"WITH {ENTITIES} SELECT entity_id, max(trace_id) AS last_trace FROM entities GROUP BY 1 HAVING max(trace_id) >= 500")
def dom_graph_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assets(entities(spark, sf_dir)).groupBy("entity_id").agg(F.max("last_trace").alias("last_trace")).where("last_trace >= 500")


@register("dom_auto_clear", f"WITH {CLASSIFIED} SELECT trace_id, review_required AND confidence >= 0.7 AND NOT has_contact AND conflict_status = 'none' AS cleared FROM bucketed")
def dom_auto_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = F.col("review_required") & (F.col("confidence") >= 0.7) & ~F.col("has_contact") & (F.col("conflict_status") == "none")
    return classified(spark, sf_dir).select("trace_id", cleared.alias("cleared"))


@register("dom_entity_post", f"WITH {ENTITIES} SELECT trace_id, entity_type, normalized FROM entities e WHERE NOT (entity_type = 'domain' AND EXISTS (SELECT 1 FROM entities x WHERE x.trace_id = e.trace_id AND x.entity_type = 'email' AND x.normalized LIKE '%@' || e.normalized))")
def dom_entity_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities(spark, sf_dir)
    hosts = found.where("entity_type = 'email'").select("trace_id", F.lit("domain").alias("entity_type"), F.regexp_extract("normalized", "@(.*)$", 1).alias("normalized"))
    return found.select("trace_id", "entity_type", "normalized").join(hosts, ["trace_id", "entity_type", "normalized"], "left_anti")


@register("rep_evidence_sample", f"WITH {CLASSIFIED} SELECT risk_category, trace_id FROM bucketed WHERE drop_reason IS NULL QUALIFY row_number() OVER (PARTITION BY risk_category ORDER BY quality_score DESC, trace_id) <= 12")
def rep_evidence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = classified(spark, sf_dir).where("drop_reason IS NULL").select("risk_category", "trace_id", "quality_score")
    return O.cap_by(kept, "risk_category", [F.desc("quality_score"), F.col("trace_id")], 12).drop("quality_score")


@_q("prj_annotate", r"SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS beyond_ascii, contains(text, chr(10)) AS multi_line, regexp_matches(text, '[0-9]') AS has_digit FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("text").rlike(r"[^\x00-\x7F]").alias("beyond_ascii"), F.col("text").contains("\n").alias("multi_line"), F.col("text").rlike("[0-9]").alias("has_digit"))


@_q("flt_theme_prune", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND NOT contains(lower(text), 'token') THEN 0 ELSE 1 END + contains(lower(text), 'password')::INT AS themes FROM documents")
def _(t):
    low = F.lower("text")
    themes = F.array_compact(F.array(F.lit("weak"), F.when(low.contains("password"), F.lit("login"))))
    pruned = F.when(low.contains("the") & ~low.contains("token"), F.array_remove(themes, "weak")).otherwise(themes)
    return t("documents").select("doc_id", F.size(pruned).alias("themes"))


@_q("src_failure_class", "SELECT reason, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'denied' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'parse_error' ELSE 'other' END AS reason FROM events) GROUP BY 1")
def _(t):
    said = F.element_at(F.array(*map(F.lit, ("Read timed out", "HTTP 403", "429 Too many", "cannot decode body", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").groupBy(P.failure_class(said).alias("reason")).agg(F.count("*").alias("n"))


@_q("src_raw_build", "SELECT doc_id AS trace_id, sha256(coalesce(text, '')) AS hash_id, coalesce(nullif(source, ''), 'unknown') AS source_name, 'public' AS legal_basis, length(text) AS size FROM documents")
def _(t):
    return t("documents").select(F.col("doc_id").alias("trace_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash_id"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("source_name"), F.lit("public").alias("legal_basis"), F.length("text").cast("long").alias("size"))
