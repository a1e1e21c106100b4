"""Mention, dictionary and variant queries over `documents`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import graph as G
from clueforge.operators import mentions as M
from clueforge.operators import records as R
from clueforge.operators.mining import mined_terms
from clueforge.plans.record_queries import CLASSIFIED, CLEANED
from clueforge.registry import register
from clueforge.session import materialise, table

TERMS = {"token": "credential", "password": "credential", "license": "notice", "akia": "cloud_key"}
VARIANTS = (M.Variant("spaced_mail", r"e\s*-\s*mail", "email"), M.Variant("call", r"call(?:ed|ing)?", "phone_call", ("+1", "phone"), 24), M.Variant("article", r" les? ", "the", ("est", "des"), 0))
CUES = ("token", "mail", "call", "@")

_at = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"


def _places(kind: str, matches: str, gaps: str, method: str, confidence: float) -> str:
    return f"""SELECT trace_id, source_name, '{kind}' AS entity_type, '{method}' AS method, {confidence}::DOUBLE AS confidence, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'v': m[i], 's': ({_at})::BIGINT}})) AS x
  FROM (SELECT trace_id, source_name, {matches} AS m, {gaps} AS g FROM base)"""


_parts = [_places(k, f"regexp_extract_all(t, '{p}')", f"string_split_regex(t, '{p}')", "pattern", 1.0) for k, p in G.SQL_PATTERNS.items()]
_parts += [_places("slang_term", f"regexp_extract_all(t, '(?i){w}')", f"string_split_regex(t, '(?i){w}')", "slang_dictionary", 0.88) for w in TERMS]
MENTIONS = f"{CLEANED}, placed AS ({' UNION ALL '.join(_parts)}), mentions AS (SELECT trace_id, source_name, entity_type, x.v AS entity_value, x.s AS start, (x.s + length(x.v))::BIGINT AS stop, method, confidence FROM placed)"
ADVANCED = f"""{MENTIONS}, plain AS (
  SELECT *, CASE WHEN entity_type = 'slang_term' THEN CASE lower(entity_value) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TERMS.items())} END
       WHEN entity_type = 'phone' THEN '+' || regexp_replace(entity_value, '[^0-9]', '', 'g') WHEN entity_type = 'access_key' THEN upper(entity_value) ELSE lower(entity_value) END AS normalized FROM mentions
), advanced AS (
  SELECT * EXCLUDE (start, stop), CASE WHEN length(normalized) > 6 THEN normalized[1:2] || '***' || normalized[-2:] ELSE '***' END AS masked, start, stop FROM plain
  QUALIFY row_number() OVER (PARTITION BY trace_id, entity_type, normalized ORDER BY (method <> 'pattern')::INT, start, stop) = 1
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records(table(spark, sf_dir, "documents"))


@register("dom_extract_places", f"WITH {MENTIONS} SELECT trace_id, entity_type, entity_value, start, stop, method, confidence FROM mentions")
def dom_extract_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mentions(records(spark, sf_dir), TERMS).drop("source_name", "confirmed")


@register("dom_extract_adv", f"WITH {ADVANCED} SELECT trace_id, entity_type, normalized, entity_value, start, stop, method, confidence, masked FROM advanced")
def dom_extract_adv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extract_advanced(records(spark, sf_dir), TERMS).drop("source_name")


@register("dom_slang_dict", f"WITH {MENTIONS} SELECT lower(entity_value) AS term, count(*) AS n, count(DISTINCT trace_id) AS n_traces, min(start) AS first_start FROM mentions WHERE method = 'slang_dictionary' GROUP BY 1")
def dom_slang_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.mentions(records(spark, sf_dir), TERMS, patterns={})
    return found.groupBy(F.lower("entity_value").alias("term")).agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("n_traces"), F.min("start").alias("first_start"))




@register("dom_slang_variants", f"""WITH {CLEANED}, hits AS ({' UNION ALL '.join(_places(v.name, f"regexp_extract_all(t, '(?i){v.pattern}')", f"string_split_regex(t, '(?i){v.pattern}')", v.plain, v.confidence) for v in VARIANTS)}), placed AS (SELECT trace_id, entity_type AS family, x.v AS value, x.s AS start FROM hits)
SELECT trace_id, family, value, start, (start + length(value))::BIGINT AS stop, CASE family WHEN 'spaced_mail' THEN true WHEN 'call' THEN regexp_matches(lower(t[greatest(start - 24, 0) + 1:start + length(value) + 24]), '\\+1|phone') ELSE regexp_matches(lower(t), 'est|des') END AS confirmed FROM placed JOIN base USING (trace_id)""")
def dom_slang_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.mentions(records(spark, sf_dir), variants=VARIANTS, patterns={})
    return found.select("trace_id", F.regexp_replace("method", "^variant_", "").alias("family"), F.col("entity_value").alias("value"), "start", "stop", "confirmed")


_reference = r"order|invoice|ticket|serial|no\."
_rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(M.PRIORITY)) + f" ELSE {len(M.PRIORITY) + 1} END"
POST = f"""{ADVANCED}, typed AS (
  SELECT a.*, CASE WHEN a.entity_type = 'phone' AND regexp_matches(lower(t[greatest(start - 16, 0) + 1:start]), '{_reference}') THEN 'reference_number' ELSE a.entity_type END AS kind FROM advanced a JOIN base b USING (trace_id)
), posted AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY {_rank}, start, stop, normalized)::INT AS place FROM typed
  WHERE len(list_distinct(string_split(regexp_replace(normalized, '[^A-Za-z0-9]', '', 'g'), ''))) > 2 AND lower(normalized) <> lower(source_name)
)"""


@register("dom_entity_post_order", f"WITH {POST} SELECT trace_id, kind AS entity_type, normalized, start, place FROM posted")
def dom_entity_post_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = records(spark, sf_dir)
    return M.post_processed(M.extract_advanced(base, TERMS), base).select("trace_id", "entity_type", "normalized", "start", "place")


@register("fn_context_relevance", f"WITH {MENTIONS} SELECT trace_id, start, entity_type, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * ({' + '.join(f'''contains(lower(t[greatest(start - 24, 0) + 1:stop + 24]), '{c}')::INT''' for c in CUES)})), 4) AS context_relevance FROM mentions JOIN base USING (trace_id)")
def fn_context_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = records(spark, sf_dir)
    return M.contextual(M.mentions(base, TERMS), base, CUES).select("trace_id", "start", "entity_type", "context_relevance")


@register("dom_llm_entity_merge", f"""WITH {ADVANCED}, rule AS (SELECT trace_id, entity_type, normalized, confidence FROM advanced WHERE method = 'pattern'), model AS (SELECT doc_id AS trace_id, 'email' AS entity_type, lower(regexp_extract(text, '{T.EMAIL_SQL}')) AS normalized, 0.7::DOUBLE AS confidence FROM documents WHERE regexp_matches(text, '{T.EMAIL_SQL}')
  UNION ALL SELECT doc_id, 'language', lang, 0.6::DOUBLE FROM documents WHERE lang IS NOT NULL)
SELECT coalesce(r.trace_id, m.trace_id) AS trace_id, coalesce(r.entity_type, m.entity_type) AS entity_type, coalesce(r.normalized, m.normalized) AS normalized, coalesce(r.confidence, m.confidence) AS confidence, CASE WHEN r.trace_id IS NULL THEN 'model' WHEN m.trace_id IS NULL THEN 'rule' ELSE 'model+rule' END AS origin
FROM rule r FULL JOIN model m ON r.trace_id = m.trace_id AND r.entity_type = m.entity_type AND r.normalized = m.normalized""")
def dom_llm_entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rule = M.extract_advanced(records(spark, sf_dir), TERMS).where("method = 'pattern'").select("trace_id", "entity_type", "normalized", "confidence")
    said = docs.where(F.col("text").rlike(T.EMAIL)).select(F.col("doc_id").alias("trace_id"), F.lit("email").alias("entity_type"), F.lower(F.regexp_extract("text", T.EMAIL, 0)).alias("normalized"), F.lit(0.7).alias("confidence"))
    named = docs.where("lang is not null").select(F.col("doc_id").alias("trace_id"), F.lit("language").alias("entity_type"), F.col("lang").alias("normalized"), F.lit(0.6).alias("confidence"))
    return M.merged_entities(rule, said.unionByName(named))


@register("svc_slang_similar")
def svc_slang_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).where(F.length("term").between(4, 12)).distinct()
    return M.near_terms(words.select(F.col("term").alias("query_id"), "term"), TERMS)


_intel = "t"
for _raw, _plain in T.VARIANTS:
    _intel = f"replace({_intel}, '{_raw}', '{_plain}')"


@register("svc_prompt_eval", "SELECT conv_id, turn, round((contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'und')::INT + contains(lower(coalesce(text, '')), 'que')::INT + contains(lower(coalesce(text, '')), 'les')::INT) / 4.0::DOUBLE, 4) AS coverage FROM conversations")
def svc_prompt_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.prompt_coverage(F.col("text"), ("the", "und", "QUE", "les")).alias("coverage"))


@register("fn_normalize_intel", rf"""WITH {CLEANED} SELECT trace_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)\bv\s*x\b', 'vx', 'g'), '(?i)\bw\s*x\b', 'vx', 'g'), '(?i)\bd\s*y\b', 'dy', 'g'), '\s+', ' ', 'g'))) AS value FROM (SELECT trace_id, {_intel} AS v FROM (SELECT trace_id, 'V x, w X ' || t || ' ✈️ d y' AS t FROM base))""")
def fn_normalize_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = records(spark, sf_dir)
    return base.select("trace_id", F.sha1(T.normalize_intel(F.concat(F.lit("V x, w X "), F.col("clean_text"), F.lit(" ✈️ d y")))).alias("value"))


#: Runs of letters stand for the CJK runs of the rule, as the tables hold none; known words and stop terms.
_RUN, _KNOWN, _STOP = "[a-zß-öø-ÿ]{2,12}", ("the", "und"), ("en", "in", "de", "on")
_gram_rows = " UNION ALL ".join(f"SELECT trace_id, unnest(list_transform(range(1, length(r) - {n} + 2), lambda i: r[i:i + {n} - 1])) AS term FROM runs WHERE length(r) >= {n}" for n in (2, 3, 4))


@register("agg_slang_mine", rf"""WITH {CLASSIFIED}, runs AS (SELECT trace_id, unnest(regexp_extract_all(lower(t), '{_RUN}')) AS r FROM base), grams AS ({_gram_rows}),
top AS (SELECT term, count(*) AS count, count(DISTINCT trace_id) AS document_count FROM grams WHERE term NOT IN ({", ".join(f"'{w}'" for w in _STOP)}) AND NOT contains(term, 'the') AND NOT contains(term, 'und') GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 80),
s AS (SELECT term, trace_id FROM (SELECT DISTINCT term, trace_id FROM grams SEMI JOIN top USING (term)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY trace_id) <= 10)
SELECT term, any_value(count) AS count, any_value(document_count) AS document_count, string_agg(trace_id::VARCHAR, ',' ORDER BY trace_id) AS sample_ids FROM top JOIN s USING (term) GROUP BY 1""")
def agg_slang_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = R.records(table(spark, sf_dir, "documents")).select(F.col("trace_id").alias("id"), F.lower("clean_text").alias("text"))
    found = mined_terms(materialise(records, "mining"), _RUN, known=_KNOWN, stop=_STOP)
    return found.select("term", "count", "document_count", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("sample_ids"))
