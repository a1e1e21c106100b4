"""Entity, graph and clue queries over `documents` and `events`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import graph as G
from clueforge.operators import records as R
from clueforge.operators.retrieval import clue_index, retrieve
from clueforge.plans.record_queries import CLASSIFIED, classified
from clueforge.registry import register
from clueforge.rules import FIXTURE
from clueforge.session import table

_found = " UNION ALL ".join(f"SELECT trace_id, source_name, '{k}' AS entity_type, unnest(regexp_extract_all(t, '{p}')) AS entity_value FROM base" for k, p in G.SQL_PATTERNS.items())
ENTITIES = f"""{CLASSIFIED}, found AS ({_found}), normal AS (
  SELECT *, CASE WHEN entity_type = 'phone' THEN '+' || regexp_replace(entity_value, '[^0-9]', '', 'g') WHEN entity_type = 'access_key' THEN upper(entity_value) ELSE lower(entity_value) END AS normalized FROM found
), entities AS (
  SELECT trace_id, source_name, entity_type, normalized, min(entity_value) AS entity_value, count(*) AS n,
         CASE WHEN length(normalized) > 6 THEN normalized[1:2] || '***' || normalized[-2:] ELSE '***' END AS masked, sha256('clueforge:' || normalized) AS canonical_hash,
         'entity:' || entity_type || ':' || sha256(entity_type || ':' || normalized)[1:16] AS entity_id
  FROM normal GROUP BY ALL
), relations AS (
  SELECT a.entity_id AS src, b.entity_id AS dst, count(DISTINCT a.trace_id) AS n_traces, 0.72::DOUBLE AS confidence FROM entities a JOIN entities b ON a.trace_id = b.trace_id AND a.entity_id < b.entity_id GROUP BY ALL
), per AS (
  SELECT entity_type, normalized, risk_category, count(*) AS n, min(trace_id) AS first FROM entities JOIN bucketed USING (trace_id) GROUP BY ALL
), top_category AS (
  SELECT entity_type, normalized, risk_category FROM per QUALIFY row_number() OVER (PARTITION BY entity_type, normalized ORDER BY n DESC, first) = 1
), clues AS (
  SELECT entity_type, normalized AS key, risk_category, count(DISTINCT trace_id) AS n_traces, count(DISTINCT e.source_name) AS n_sources, round(avg(b.confidence), 4) AS avg_confidence, min(trace_id) AS first_trace, max(trace_id) AS last_trace,
         'shared_' || entity_type AS clue_type, 'clue:' || sha256('shared_' || entity_type || ':' || normalized)[1:16] AS clue_id,
         round(least(0.98::DOUBLE, 0.62::DOUBLE + count(DISTINCT trace_id) * 0.08::DOUBLE + count(DISTINCT e.source_name) * 0.04::DOUBLE), 4) AS confidence
  FROM entities e JOIN (SELECT trace_id, confidence FROM bucketed) b USING (trace_id) JOIN top_category USING (entity_type, normalized)
  GROUP BY entity_type, normalized, risk_category HAVING count(DISTINCT trace_id) >= 2 AND count(DISTINCT e.source_name) >= 2
), risked_clues AS (
  SELECT *, round(least(0.1::DOUBLE + CASE WHEN n_sources < 2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN n_traces < 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN entity_type IN ('email', 'phone', 'domain', 'access_key') THEN 0::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN avg_confidence < 0.55 THEN 0.2::DOUBLE ELSE 0 END, 0.99::DOUBLE), 4) AS false_positive_risk FROM clues
), rated AS (
  SELECT *, round(greatest(0.0::DOUBLE, least(confidence * 0.45::DOUBLE + least(n_traces, 4) / 4.0::DOUBLE * 0.2::DOUBLE + least(n_sources, 3) / 3.0::DOUBLE * 0.2::DOUBLE + avg_confidence * 0.15::DOUBLE + 0.5::DOUBLE * 0.08::DOUBLE - false_positive_risk * 0.12::DOUBLE, 0.99::DOUBLE)), 4) AS clue_quality FROM risked_clues
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract(R.records(table(spark, sf_dir, "documents")))


def classed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the risk category and confidence of their records, in one pass over the texts."""
    return G.extract(classified(spark, sf_dir).select("trace_id", "source_name", "clean_text", "risk_category", "confidence"), ("risk_category", "confidence"))


def clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_clues(classed_entities(spark, sf_dir))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality(clues(spark, sf_dir), F.lit(0.5))


@register("dom_extract_basic", f"WITH {ENTITIES} SELECT trace_id, entity_type, entity_value, normalized, n, masked, canonical_hash, entity_id FROM entities")
def dom_extract_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).drop("source_name")


def _hashed(value: str) -> str:
    masked = "regexp_replace(" * len(T.PII) + f"trim({value})" + "".join(f", '{p}', '{label}', 'g')" for label, p in T.SQL_PII)
    return f"""CASE WHEN {masked} <> trim({value}) OR regexp_matches(lower(trim({value})), '{T.ACCOUNT_MARKS}') OR regexp_matches(trim({value}), '{T.MOBILE}') OR regexp_matches(trim({value}), '{T.HANDLE}')
         THEN 'hash:' || sha256(to_json(trim({value}))::VARCHAR)[1:12] ELSE trim({value}) END"""


@register("fn_mask_or_hash", f"WITH {ENTITIES} SELECT trace_id, entity_id, {_hashed('entity_value')} AS value, {_hashed('source_name')} AS source FROM entities")
def fn_mask_or_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("trace_id", "entity_id", T.mask_or_hash(F.col("entity_value")).alias("value"), T.mask_or_hash(F.col("source_name")).alias("source"))


#: A card for the entities of one type in one record; no group is larger than a text.
@register("fn_card_id", f"""WITH {ENTITIES}, cards AS (
  SELECT trace_id, source_name, entity_type, min(normalized) AS key, list_sort(list({_hashed('normalized')})) AS vals FROM entities GROUP BY ALL
) SELECT trace_id, entity_type, 'card_' || sha256(to_json({{'clue_type': 'record_' || entity_type, 'entity_values': vals, 'evidence_trace_ids': [trace_id::VARCHAR], 'key': key, 'risk_category': risk_category, 'source_names': [cards.source_name]}})::VARCHAR)[1:12] AS card
FROM cards JOIN (SELECT trace_id, risk_category FROM bucketed) USING (trace_id)""")
def fn_card_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = classed_entities(spark, sf_dir).groupBy("trace_id", "source_name", "entity_type", "risk_category").agg(F.min("normalized").alias("key"), F.collect_list("normalized").alias("values"))
    card = T.card_id(F.concat(F.lit("record_"), "entity_type"), F.col("key"), F.col("risk_category"), F.array("trace_id"), F.array("source_name"), F.col("values"))
    return cards.select("trace_id", "entity_type", card.alias("card"))


@register("agg_counter_entity_type", f"WITH {ENTITIES} SELECT entity_type, count(*) AS n, count(DISTINCT normalized) AS distinct_values FROM entities GROUP BY 1")
def agg_counter_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("normalized").alias("distinct_values"))


@register("agg_graph_upsert", f"WITH {ENTITIES} SELECT entity_id, entity_type, masked, count(DISTINCT entity_value) AS n_aliases, min(trace_id) AS first_trace, max(trace_id) AS last_trace, count(DISTINCT trace_id) AS n_traces, count(DISTINCT source_name) AS n_sources FROM entities GROUP BY ALL")
def agg_graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assets(entities(spark, sf_dir))


@register("dom_graph_build", f"WITH {ENTITIES} SELECT * FROM relations")
def dom_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cooccurrence(entities(spark, sf_dir))


@register("agg_cross_source", f"WITH {ENTITIES} SELECT entity_id, count(DISTINCT source_name) AS n_sources FROM entities GROUP BY 1 HAVING count(DISTINCT source_name) >= 2")
def agg_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).groupBy("entity_id").agg(F.countDistinct("source_name").alias("n_sources")).where("n_sources >= 2")


@register("agg_risk_profile", f"""WITH {ENTITIES}, seen AS (
  SELECT entity_id, count(DISTINCT trace_id) AS observations, count(DISTINCT e.source_name) AS sources, count(DISTINCT CASE WHEN risk_category NOT IN ('unknown', 'normal_noise') THEN risk_category END) AS n_categories
  FROM entities e LEFT JOIN (SELECT trace_id, risk_category FROM bucketed) USING (trace_id) GROUP BY 1
), near AS (SELECT entity_id, count(*) AS k FROM (SELECT src AS entity_id FROM relations UNION ALL SELECT dst FROM relations) GROUP BY 1)
SELECT entity_id, observations, sources, n_categories, coalesce(k, 0) AS neighbours, least(99, 28 + 5 * least(observations, 10) + 6 * least(sources, 5) + 4 * least(coalesce(k, 0), 8) + 16 * (n_categories > 0)::INT)::BIGINT AS risk_score FROM seen LEFT JOIN near USING (entity_id)""")
def agg_risk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities(spark, sf_dir)
    return G.risk_profiles(found, G.cooccurrence(found), classified(spark, sf_dir).select("trace_id", "risk_category"))


@register("dom_graph_neighborhood", f"""WITH {ENTITIES}, both_ways AS (SELECT src AS a, dst AS b FROM relations UNION ALL SELECT dst, src FROM relations), start AS (SELECT DISTINCT entity_id FROM entities WHERE entity_type = 'email'),
h1 AS (SELECT b AS entity_id, 1 AS hops FROM start JOIN both_ways ON a = entity_id), h01 AS (SELECT entity_id, 0 AS hops FROM start UNION ALL SELECT * FROM h1), r1 AS (SELECT entity_id, min(hops) AS hops FROM h01 GROUP BY 1),
h2 AS (SELECT b AS entity_id, 2 AS hops FROM r1 JOIN both_ways ON a = entity_id WHERE hops = 1)
SELECT entity_id, min(hops)::INT AS hops FROM (SELECT * FROM r1 UNION ALL SELECT * FROM h2) GROUP BY 1""")
def dom_graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities(spark, sf_dir)
    return G.neighborhood(G.cooccurrence(found), found.where("entity_type = 'email'"))


@register("agg_shared_contact", f"WITH {ENTITIES} SELECT clue_id, clue_type, key, risk_category, n_traces, n_sources, avg_confidence, confidence FROM clues")
def agg_shared_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clues(spark, sf_dir).select("clue_id", "clue_type", "key", "risk_category", "n_traces", "n_sources", "avg_confidence", "confidence")


@register("agg_dominant_category", f"WITH {ENTITIES} SELECT entity_type, normalized, risk_category FROM top_category")
def agg_dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir).join(classified(spark, sf_dir).select("trace_id", "risk_category"), "trace_id")
    per = rows.groupBy("entity_type", "normalized", "risk_category").agg(F.count("*").alias("n"), F.min("trace_id").alias("first"))
    return per.groupBy("entity_type", "normalized").agg(F.max_by("risk_category", F.struct("n", -F.col("first"))).alias("risk_category"))


_score = "round(least(0.99::DOUBLE, 0.2::DOUBLE + least(n_traces, 4) * 0.12::DOUBLE + least(n_sources, 3) * 0.12::DOUBLE + 0.06::DOUBLE + CASE WHEN entity_type IN ('email', 'phone', 'domain') THEN 0.18::DOUBLE ELSE 0 END), 4)"
_enough = "n_sources >= {min_sources} AND n_traces >= {min_traces}"
_fits = lambda r: "entity_type IN (" + ", ".join(f"'{x}'" for x in r["types"]) + ")"


@register("dom_promote", f"WITH {ENTITIES} SELECT clue_id, {_score} AS actionability, CASE {' '.join(f'WHEN {_fits(r)} THEN {_enough.format(**r)}' for r in FIXTURE.promotion)} ELSE false END AS promoted, CASE {' '.join(f'''WHEN {_fits(r)} THEN CASE WHEN {_enough.format(**r)} THEN '{r['pass']}' ELSE '{r['fail']}' END''' for r in FIXTURE.promotion)} ELSE 'no_promotion_rule_matched' END AS promotion_reason FROM clues")
def dom_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.promote(clues(spark, sf_dir), FIXTURE).select("clue_id", "actionability", "promoted", "promotion_reason")


@register("fn_clue_quality", f"WITH {ENTITIES} SELECT clue_id, false_positive_risk, clue_quality, CASE WHEN clue_quality >= 0.82 THEN 'high' WHEN clue_quality >= 0.65 THEN 'medium' ELSE 'low' END AS quality_level, clue_quality >= 0.65 AS passed FROM rated")
def fn_clue_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).select("clue_id", "false_positive_risk", "clue_quality", "quality_level", "passed")


@register("win_identity_best", f"WITH {ENTITIES} SELECT clue_type, risk_category, clue_id, clue_quality FROM rated QUALIFY row_number() OVER (PARTITION BY clue_type, risk_category ORDER BY clue_quality DESC, n_traces DESC, n_sources DESC, key) = 1")
def win_identity_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_of_identity(rated(spark, sf_dir)).select("clue_type", "risk_category", "clue_id", "clue_quality")


@register("dom_evidence_chain", f"WITH {ENTITIES} SELECT clue_id, trace_id, source_name, CASE WHEN length(t) <= 160 THEN t ELSE t[1:157] || '...' END AS excerpt FROM clues c JOIN (SELECT entity_type, normalized, trace_id FROM entities) e ON c.entity_type = e.entity_type AND c.key = e.normalized JOIN base USING (trace_id)")
def dom_evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence(clues(spark, sf_dir), entities(spark, sf_dir), R.records(table(spark, sf_dir, "documents")))


_masked = "t"
for _label, _pattern in T.SQL_PII:
    _masked = f"regexp_replace({_masked}, '{_pattern}', '{_label}', 'g')"


@register("agg_template", rf"""WITH {CLASSIFIED}, k AS (SELECT trace_id, source_name, regexp_replace(lower({_masked}), '[^\p{{L}}\p{{N}}]', '', 'g')[1:80] AS key FROM base), per AS (SELECT key, count(DISTINCT trace_id) AS n_traces, count(DISTINCT source_name) AS n_sources FROM k WHERE length(key) >= 12 GROUP BY 1),
u AS (SELECT *, 'shared_template' AS clue_type FROM per WHERE n_traces >= 2 AND n_sources >= 2 UNION ALL SELECT *, 'high_frequency_template' FROM per WHERE n_traces >= 3) SELECT *, round(least(0.98::DOUBLE, 0.62::DOUBLE + n_traces * 0.08::DOUBLE + n_sources * 0.04::DOUBLE), 4) AS confidence FROM u""")
def agg_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.template_clues(R.records(table(spark, sf_dir, "documents")))


#: A question, the risks and sources it asks for, and how far back clues count as fresh (records stand for hours).
_ASKED, _RISKS, _PREFERRED = ("shared", "email", "mail2", "src0", "domain", "example", "phone"), ("credential", "prose"), ("src0", "src3")
_clue_words = "list_distinct(regexp_extract_all(lower(clue_type || ' ' || key || ' ' || key || ' ' || array_to_string(sources, ' ')), '[a-z0-9]+'))"
_any = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@register("topk_clue_retrieve", f"""WITH {ENTITIES}, named AS (SELECT 'clue:' || sha256('shared_' || entity_type || ':' || normalized)[1:16] AS clue_id, list_sort(list(DISTINCT source_name)) AS sources FROM entities GROUP BY 1),
matched AS (SELECT clue_id, clue_quality, confidence, len(list_intersect({_clue_words}, [{", ".join(f"'{w}'" for w in _ASKED)}])) AS overlap,
  CASE WHEN {_any("lower(risk_category)", _RISKS)} THEN 0.35 ELSE 0 END + CASE WHEN {_any("lower(array_to_string(sources, ' '))", _PREFERRED)} THEN 0.15 ELSE 0 END + CASE WHEN len(sources) >= 2 THEN 0.2 ELSE 0 END AS extra FROM rated JOIN named USING (clue_id) WHERE clue_quality >= 0.3),
ranked AS (SELECT clue_id, round(0.12::DOUBLE * least(overlap, 6) + extra + 0.1::DOUBLE * least(clue_quality, 1) + 0.08::DOUBLE * least(confidence, 1), 6) AS score, overlap, clue_quality, confidence FROM matched)
SELECT clue_id, round(score, 4) AS score, overlap, row_number() OVER (ORDER BY score DESC, clue_quality DESC, confidence DESC, clue_id)::INT AS place FROM ranked WHERE score > 0 QUALIFY place <= 30""")
def topk_clue_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = entities(spark, sf_dir).select(G.clue_id(F.concat(F.lit("shared_"), "entity_type"), F.col("normalized")).alias("id"), "source_name").groupBy("id").agg(F.array_sort(F.collect_set("source_name")).alias("sources"))
    items = rated(spark, sf_dir).select(F.col("clue_id").alias("id"), "clue_type", "key", F.array("key").alias("entities"), "risk_category", F.col("clue_quality").alias("quality"), "confidence", F.col("last_trace").alias("seen")).join(named, "id")
    found = retrieve(clue_index(items), _ASKED, 30, _RISKS, _PREFERRED, True, least_quality=0.3)
    return found.select(F.col("id").alias("clue_id"), F.round("score", 4).alias("score"), "overlap", "place")
