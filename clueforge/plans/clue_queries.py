"""Clue decisions over `events`, and over clues, runs and texts of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import clues as C
from clueforge.operators import records as R
from clueforge.plans.graph_queries import ENTITIES, _masked, clues, entities
from clueforge.plans.record_queries import classified
from clueforge.registry import register
from clueforge.session import materialise, table

_CORROBORATED = """a AS (SELECT event_id AS id, event_type AS source, floor(epoch(ts))::BIGINT AS s FROM events), b AS (SELECT event_id AS id, event_type AS source, floor(epoch(ts))::BIGINT AS s FROM events),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, abs(a.s - b.s) // 60 AS minutes FROM a JOIN b ON b.s BETWEEN a.s - 172800 AND a.s + 172800 AND a.source <> b.source
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY ((b.s, b.id) < (a.s, a.id))::INT, b.s, b.id) = 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    return C.corroborated(rows, rows)


@register("join_asof_corroborate", f"WITH {_CORROBORATED} SELECT a_id, b_id, minutes FROM pairs")
def join_asof_corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@register("win_order_distance", """WITH o AS (SELECT event_id AS id, event_type AS source, floor(epoch(ts))::BIGINT AS s, row_number() OVER (ORDER BY floor(epoch(ts))::BIGINT, event_id) - 1 AS i, count(*) OVER () AS n FROM events WHERE ts IS NOT NULL)
SELECT a.id, b.id AS other, CASE WHEN a.i = b.i THEN a.n ELSE (b.i - a.i + a.n) % a.n END AS distance, abs(a.s - b.s) // 60 AS minutes FROM o a JOIN o b ON b.s BETWEEN a.s - 172800 AND a.s + 172800 AND a.source <> b.source AND a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (b.i - a.i + a.n) % a.n) = 1""")
def win_order_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.order_distances(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts")))


_TYPES = {"agg_ctx_contact": (("email", "phone"),), "agg_ctx_account_tool": (("email", "domain"), ("ip", "access_key", "domain")), "agg_ctx_tool_trade": (("ip", "access_key"), ("phone", "email"))}
_lone = "lone AS (SELECT entity_type, normalized, min(trace_id) AS trace_id FROM entities GROUP BY 1, 2 HAVING count(DISTINCT trace_id) = 1)"


def _bridge(name: str, need: tuple[tuple[str, ...], ...]) -> None:
    quoted = lambda group: ", ".join(f"'{x}'" for x in group)
    has = " AND ".join(f"trace_id IN (SELECT trace_id FROM lone WHERE entity_type IN ({quoted(g)}))" for g in need)

    @register(name, f"WITH {ENTITIES}, {_CORROBORATED}, {_lone} SELECT '{name[4:]}' AS clue_type, normalized AS key, trace_id, b_id AS other FROM lone JOIN pairs ON a_id = trace_id WHERE entity_type IN ({quoted(need[0])}) AND {has}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.bridged(entities(spark, sf_dir), _pairs(spark, sf_dir), name[4:], need)


for _name, _need in _TYPES.items():
    _bridge(_name, _need)


_kinds = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.KINDS.items()) + " END"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)


def objects_sql(only: str = "true") -> str:
    """clue_objects in SQL, over the documents for which `only` holds."""
    return rf"""{ENTITIES}, own AS (SELECT {_kinds} AS clue_type, normalized AS key, trace_id, source_name, entity_type FROM entities WHERE {only}),
has AS (SELECT trace_id FROM own GROUP BY 1 HAVING bool_or(entity_type IN ({_quoted(C.ACCOUNTS)})) AND bool_or(entity_type IN ({_quoted(C.TOOLS)}))),
linked AS (SELECT CASE WHEN entity_type IN ({_quoted(C.TOOLS)}) THEN '{C.SPECIFIC[0]}' ELSE '{C.SPECIFIC[1]}' END AS clue_type, key, trace_id, source_name FROM own SEMI JOIN has USING (trace_id) WHERE entity_type IN ({_quoted(C.ACCOUNTS + C.TOOLS)})),
keyed AS (SELECT trace_id, source_name, regexp_replace(lower({_masked}), '[^\p{{L}}\p{{N}}]', '', 'g')[1:80] AS key FROM base WHERE {only}),
members AS (SELECT DISTINCT clue_type, key, trace_id, source_name FROM (SELECT clue_type, key, trace_id, source_name FROM own UNION ALL SELECT * FROM linked UNION ALL SELECT unnest(['shared_template_multi_source', 'high_frequency_template']), key, trace_id, source_name FROM keyed WHERE length(key) >= 12)),
ranked_risks AS (SELECT clue_type, key, risk_category FROM (SELECT clue_type, key, risk_category, count(*) AS n, min(trace_id) AS first FROM members JOIN (SELECT trace_id, risk_category FROM bucketed) USING (trace_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clue_type, key ORDER BY n DESC, first) = 1),
objects AS (SELECT *, 'clue:' || sha256(clue_type || ':' || key)[1:16] AS clue_id, round(least(0.98::DOUBLE, 0.62::DOUBLE + n_traces * 0.08::DOUBLE + n_sources * 0.04::DOUBLE), 4) AS confidence, CASE WHEN n_traces = 1 AND clue_type IN ({_quoted(sorted(set(C.KINDS.values())))}) THEN '{C.BRIDGE}' END AS weak_reason
  FROM (SELECT clue_type, key, count(*) AS n_traces, count(DISTINCT source_name) AS n_sources, array_to_string(list_sort(list(trace_id)), ',') AS chain FROM members GROUP BY 1, 2) JOIN ranked_risks USING (clue_type, key)
  WHERE CASE clue_type WHEN 'high_frequency_template' THEN n_traces >= 3 WHEN 'shared_template_multi_source' THEN n_traces >= 2 AND n_sources >= 2 ELSE true END)"""


def objects(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The clues that the engine finds in `documents`, or in those whose trace_id is in `only`."""
    some = (lambda df: df) if only is None else (lambda df: df.join(only, "trace_id", "left_semi"))
    found = some(entities(spark, sf_dir))
    templates = some(R.records(table(spark, sf_dir, "documents"))).select("trace_id", "source_name", F.substring(T.canonical(T.mask_pii(F.col("clean_text"))), 1, 80).alias("key")).where(F.length("key") >= 12)
    return materialise(C.clue_objects(materialise(found, "clue-entities"), templates, classified(spark, sf_dir)), "clue-objects")


@register("dom_supersede", f"""WITH {objects_sql()}, k AS (SELECT *, lower(trim(key)) AS nk FROM objects) SELECT clue_id, CASE
  WHEN clue_type = 'shared_contact_48h' AND weak_reason = '{C.BRIDGE}' AND chain IN (SELECT chain FROM k WHERE clue_type = 'shared_domain_multi_source') THEN 'superseded_by_same_chain_domain_clue'
  WHEN clue_type = 'shared_contact_48h' AND weak_reason = '{C.BRIDGE}' AND (nk, chain) IN (SELECT (nk, chain) FROM k WHERE clue_type = 'entity_graph_tool_trade_cluster') THEN 'superseded_by_same_chain_tool_cluster'
  WHEN clue_type IN ('shared_contact_48h', 'shared_tool_multi_source') AND NOT regexp_matches(nk, '^(telegram:|wechat:|qq:|tg:|wx:|@)') AND (nk, chain) IN (SELECT (nk, chain) FROM k WHERE clue_type IN ('entity_graph_account_tool_overlap', 'entity_graph_tool_trade_cluster')) THEN 'superseded_by_more_specific_graph_clue' END AS archive_reason FROM k""")
def dom_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.superseded(objects(spark, sf_dir)).select("clue_id", "archive_reason")


_BULK = f"""bulk AS (SELECT DISTINCT risk_category FROM objects WHERE contains(clue_type, 'template') AND n_traces >= 3),
stands AS (SELECT clue_id, row_number() OVER (PARTITION BY clue_type ORDER BY confidence DESC, n_traces DESC, n_sources DESC, clue_id DESC) AS place FROM objects WHERE clue_type IN ('shared_contact_48h', 'shared_domain_multi_source') AND risk_category IN (SELECT risk_category FROM bulk)),
judged AS (SELECT o.*, CASE WHEN place > 1 THEN 'bulk_template_' || clue_type || '_represented_by_top_evidence' WHEN place IS NULL AND contains(clue_type, 'template') AND NOT regexp_matches(key, '[.:@]') AND EXISTS (SELECT 1 FROM bulk) THEN 'template_pattern_kept_in_candidate_pool_requires_key_entity_support' END AS archive_reason FROM objects o LEFT JOIN stands USING (clue_id))"""


@register("win_bulk_template", f"WITH {objects_sql()}, {_BULK} SELECT clue_id, archive_reason FROM judged")
def win_bulk_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bulk_represented(objects(spark, sf_dir), 3).select("clue_id", "archive_reason")


@register("win_bulk_representative", f"WITH {objects_sql()}, {_BULK} SELECT clue_type, count(*) AS n, count(*) FILTER (archive_reason IS NULL) AS kept, arg_max(clue_id, (archive_reason IS NULL, confidence, n_traces, n_sources, clue_id)) AS representative FROM judged GROUP BY 1")
def win_bulk_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.bulk_represented(objects(spark, sf_dir), 3)
    kept = F.col("archive_reason").isNull()
    return judged.groupBy("clue_type").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.max_by("clue_id", F.struct(kept, "confidence", "n_traces", "n_sources", "clue_id")).alias("representative"))


@register("svc_refine_target", f"""WITH {ENTITIES}, q AS (SELECT clue_id, confidence, clue_quality AS q, n_traces, n_sources, avg_confidence < 0.6 AS review, CASE WHEN n_traces > 2 THEN 'seen often' ELSE '' END AS summary, n_traces > 4 AS refined, entity_type = 'ip' AND n_sources < 3 AS weak FROM rated)
SELECT clue_id, CASE WHEN weak THEN 'weak_graph_clue_without_sensitive_entity' WHEN refined AND q >= 0.82 AND n_traces >= 2 THEN 'already_refined_complete_high_quality' WHEN q >= 0.65 AND n_traces >= 2 AND n_sources >= 2 AND NOT review AND summary <> '' THEN 'actionable_complete_without_refine_need'
  WHEN review THEN 'conflict_review' WHEN q >= 0.65 AND (summary = '' OR confidence < 0.78) THEN 'actionable_missing_summary_or_confidence' WHEN q >= 0.53 AND q < 0.65 THEN 'near_threshold_high_risk' ELSE 'outside_refine_target_policy' END AS reason,
  reason IN ('conflict_review', 'actionable_missing_summary_or_confidence', 'near_threshold_high_risk') AS refine FROM q""")
def svc_refine_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clueforge.plans.graph_queries import rated

    c = F.col
    wanted, reason = C.refine_target(c("clue_quality"), c("confidence"), c("n_traces"), c("n_sources"), F.lit(1), c("avg_confidence") < 0.6, F.when(c("n_traces") > 2, "seen often").otherwise(""), c("n_traces") > 4, (c("entity_type") == "ip") & (c("n_sources") < 3))
    return rated(spark, sf_dir).select("clue_id", reason.alias("reason"), wanted.alias("refine"))


#: A run for each source and language: what the labels say it gained, and what it cost.
@register("dom_value_gate", """WITH r AS (SELECT source || '/' || lang AS run, CASE WHEN lang = 'fr' THEN ' Fast' ELSE 'full' END AS profile, count(l.doc_id) > 0 AS has_metrics, CASE WHEN lang = 'es' AND count(l.doc_id) > 2 THEN 'Conflict_only ' END AS explicit, CASE WHEN count(*) < 4 THEN false END AS enabled,
  round(avg(quality) - 0.5, 6) AS g1, round(avg(toxic) - 0.1, 6) AS g2, sum(n_chars)::DOUBLE / nullif(sum(quality), 0) AS tokens FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang)
SELECT run, CASE WHEN lower(trim(profile)) = 'fast' THEN 'disabled' WHEN NOT has_metrics THEN 'hard_cases_only' WHEN lower(trim(explicit)) IN ('enabled', 'hard_cases_only', 'conflict_only', 'disabled') THEN lower(trim(explicit))
  WHEN NOT coalesce(enabled, true) THEN 'conflict_only' WHEN greatest(coalesce(g1, 0), coalesce(g2, 0)) < 0.01 AND (tokens IS NULL OR tokens > 10000) THEN 'conflict_only' ELSE 'enabled' END AS policy FROM r""")
def dom_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(1)), "doc_id", "left")
    seen = F.count("labelled")
    runs = rows.groupBy("source", "lang").agg(
        (seen > 0).alias("has_metrics"), F.when((F.col("lang") == "es") & (seen > 2), "Conflict_only ").alias("explicit"), F.when(F.count("*") < 4, False).alias("enabled"),
        F.round(F.avg("quality") - 0.5, 6).alias("g1"), F.round(F.avg("toxic") - 0.1, 6).alias("g2"), F.try_divide(F.sum("n_chars").cast("double"), F.sum("quality").cast("double")).alias("tokens"),
    )
    policy = C.enrich_policy(F.when(F.col("lang") == "fr", " Fast").otherwise("full"), F.col("has_metrics"), F.col("explicit"), F.col("enabled"), [F.col("g1"), F.col("g2")], F.col("tokens"))
    return runs.select(F.concat("source", F.lit("/"), "lang").alias("run"), policy.alias("policy"))


#: Words that stand for the breaches in invented prose; texts stand for actions and sources for targets.
_BREACHES = (("formal_write", ("licensed", "copyright")), ("online_enforcement", ("idiot", "stupid")), ("unauthorized_collection", ("password", "token")))
_LOCAL, _OUTBOUND, _PERSONAL = ("src0", "src1"), ("est", "der", "is"), ("que", "und", "that")
_hit = lambda col, words: f"regexp_matches({col}, '" + "|".join(rf"\b{w}\b" for w in words) + "')"


@register("dom_policy_guard", f"""SELECT doc_id, CASE WHEN {_hit('a', _BREACHES[0][1])} THEN 'formal_write' WHEN {_hit('a', _BREACHES[1][1])} THEN 'online_enforcement' WHEN NOT ({_hit('t', _LOCAL)} OR {_hit('a', _LOCAL)}) AND {_hit('a', _OUTBOUND)} AND {_hit('a', _PERSONAL)} THEN 'pii_exfiltration'
  WHEN {_hit('a', _BREACHES[2][1])} THEN 'unauthorized_collection' END AS breach FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g')) AS a, lower(coalesce(source, '')) AS t FROM documents)""")
def dom_policy_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", C.safety_breach(text, F.col("source"), _BREACHES, _LOCAL, _OUTBOUND, _PERSONAL).alias("breach"))


@register("dom_countermeasure", f"""WITH {ENTITIES} SELECT 'strategy:' || sha256(clue_id || ':strategy')[1:12] AS strategy_id, clue_id AS target_id, 'review ' || clue_type || '=' || key AS recommendation, 'review_only_dashboard_then_low_impact_monitoring' AS scope, 'auto_ban,auto_block,auto_blacklist,production_strategy_write' AS forbidden, round(confidence, 4) AS confidence FROM clues""")
def dom_countermeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suggestions(clues(spark, sf_dir))
