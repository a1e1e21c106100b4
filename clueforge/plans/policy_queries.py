"""Decision queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.operators import graph as G
from clueforge.operators import policy as P
from clueforge.operators import records as R
from clueforge.plans.graph_queries import ENTITIES, clues, entities, rated
from clueforge.plans.relational_queries import _q
from clueforge.registry import register
from clueforge.session import materialise, table

_BASIS = "CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'Authorized' WHEN 2 THEN 'scraped' END"


@_q("flt_source_policy", f"SELECT decision, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(lower({_BASIS}) IN ('public', 'authorized', 'partner', 'synthetic'), false) THEN 'rejected_legal_basis' WHEN source = 'src3' THEN 'rejected_forbidden_marker' ELSE 'accepted' END AS decision FROM documents) GROUP BY 1")
def _(t):
    note = F.when(F.col("source") == "src3", "needs LOGIN").otherwise("open")
    i = F.col("doc_id") % 4
    basis = F.when(i == 0, "public").when(i == 1, "Authorized").when(i == 2, "scraped")
    return t("documents").groupBy(P.source_decision(basis, note).alias("decision")).agg(F.count("*").alias("n"))


@_q("flt_source_guard", r"SELECT page_id, CASE WHEN regexp_matches(url, 'https?://[^/\s:@]+:[^/\s@]+@') THEN 'credentials_in_url' WHEN page_id % 5 = 0 THEN 'missing_legal_basis' ELSE 'ok' END AS rule FROM pages")
def _(t):
    return t("pages").select("page_id", P.guard(F.col("url"), F.when(F.col("page_id") % 5 != 0, "public")).alias("rule"))


@_q("flt_compliance", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'REJECTED' WHEN page_id % 3 = 0 THEN 'NEEDS_LEGAL_REVIEW' WHEN page_id % 2 = 0 THEN 'NEEDS_RATE_LIMIT' ELSE 'SCHEDULABLE' END AS decision FROM pages) GROUP BY 1")
def _(t):
    i = F.col("page_id")
    return t("pages").groupBy(P.compliance(F.when(i % 7 != 0, "public"), i % 2 != 0, i % 3 != 0).alias("decision")).agg(F.count("*").alias("n"))


#: Terms to look for; those of "greeting" count only beside a word of the last list.
_INCLUDE, _EXCLUDE = ("token", "password", "account"), ("license",)
_THEMES = {"greeting": ("the", "und", "que"), "contact": ("mail2.example.com", "+1 (", "example.com"), "legal": ("permission is hereby", "copyright")}
_BANNED, _WEAK = ("legal",), ("greeting", ("les", "der", "and"))


def _term_sql(term: str) -> str:
    """Whether a term stands in low as a word of its own."""
    escaped = "".join("\\" + c if c in "+.()" else c for c in term)
    return f"regexp_matches(low, '(^|[^a-z0-9_]){escaped}($|[^a-z0-9_])')" if all(c.isascii() and (c.isalnum() or c in "_ +.@:/-") for c in term) else f"contains(low, '{term}')"


_some = lambda terms: "list_filter([" + ", ".join(f"CASE WHEN {_term_sql(t)} THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"
_weak = f"len({_some(_WEAK[1])}) > 0"


@_q("flt_relevance", f"""WITH h AS (SELECT doc_id, {_some(_INCLUDE)} AS i, {_some(_EXCLUDE)} AS e, CASE WHEN {_weak} THEN {_some(_THEMES['greeting'])} ELSE [] END AS g, {_some(_THEMES['contact'])} AS c, {_some(_THEMES['legal'])} AS l FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)),
m AS (SELECT *, list_distinct(i || g || c) AS matched FROM h)
SELECT doc_id, array_to_string(list_sort(matched), ',') AS matched, array_to_string(list_sort(list_distinct(e || l)), ',') AS excluded, concat_ws(',', CASE WHEN len(g) > 0 THEN 'greeting' END, CASE WHEN len(c) > 0 THEN 'contact' END) AS themes, len(matched) AS hit_count, len(matched) >= 2 AND len(e || l) = 0 AS relevant FROM m""")
def _(t):
    found = P.relevance(t("documents"), _INCLUDE, _EXCLUDE, _THEMES, _BANNED, _WEAK, 2)
    text = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select("doc_id", text("matched"), text("excluded"), F.array_join("matched_themes", ",").alias("themes"), F.col("hit_count").cast("long").alias("hit_count"), "relevant")


@_q("flt_theme_norm", "SELECT doc_id, array_to_string(list_sort(list_distinct([CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lower(lang) END, lower(source)])), ',') AS themes FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(P.canonical_themes(F.array(F.upper("lang"), F.col("source")), {"en": "english", "de": "german"}), ",").alias("themes"))


@_q("src_quota_groups", "SELECT g, count(*) AS n FROM (SELECT unnest(['lang:' || lang, CASE WHEN n_chars > 2000 THEN 'size:long' ELSE 'size:short' END, CASE WHEN source IN ('src0', 'src1') THEN 'tier:core' END]) AS g FROM documents) WHERE g IS NOT NULL GROUP BY 1")
def _(t):
    return t("documents").select(F.explode(P.quota_groups(F.col("source"), F.col("lang"), F.col("n_chars"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@_q("dom_enforce", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN value / 100 < 0.5 THEN 'BLOCKED' WHEN event_id % 3 <> 0 THEN 'REVIEW_REQUIRED' WHEN event_id % 2 = 0 THEN 'DRY_RUN' ELSE 'READY_FOR_OPERATOR' END AS decision FROM events) GROUP BY 1")
def _(t):
    i = F.col("event_id")
    return t("events").groupBy(P.enforcement_decision(F.col("value") / 100, i % 3 == 0, i % 2 == 0).alias("decision")).agg(F.count("*").alias("n"))


@_q("svc_review_decision", "SELECT state, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'DEFERRED' ELSE 'PENDING' END AS state FROM labels) GROUP BY 1")
def _(t):
    said = F.element_at(F.array(F.lit(" OK"), F.lit("No "), F.lit("later"), F.lit("?")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("labels").groupBy(P.review_state(said).alias("state")).agg(F.count("*").alias("n"))


@_q("dom_slang_lifecycle", """WITH e AS (SELECT user_id AS term, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'seen' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'gray' WHEN 3 THEN 'active' ELSE 'rejected' END AS event FROM events),
s AS (SELECT term, max(CASE event WHEN 'seen' THEN 1 WHEN 'reviewed' THEN 2 WHEN 'gray' THEN 3 WHEN 'active' THEN 4 ELSE 0 END) AS reached, arg_max(event, seq) AS last FROM e GROUP BY 1)
SELECT term, CASE WHEN last = 'rejected' THEN 'REJECTED' WHEN reached >= 4 THEN 'ACTIVE' WHEN reached = 3 THEN 'GRAY' WHEN reached = 2 THEN 'REVIEWED' ELSE 'NEW' END AS stage FROM s""")
def _(t):
    names = F.array(*map(F.lit, ("seen", "reviewed", "gray", "active", "rejected")))
    return P.lifecycle(t("events").select(F.col("user_id").alias("term"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("event")))


@_q("dom_query_parse", """WITH q AS (SELECT conv_id, turn, lower(text || CASE WHEN turn % 2 = 0 THEN ' emails of the last 3 days' ELSE ' cross-source phone today' END) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(s, 'last 3 days') THEN 72 WHEN contains(s, 'today') THEN 24 END AS hours, regexp_matches(s, 'cross[- ]source|several sources|multiple sources') AS cross_source,
round(least(0.95::DOUBLE, 0.35::DOUBLE + 0.2::DOUBLE * (regexp_matches(s, 'e-?mail')::INT + regexp_matches(s, 'phone|call')::INT + regexp_matches(s, 'domain|site|url')::INT + regexp_matches(s, 'account|handle')::INT) + 0.2::DOUBLE + CASE WHEN regexp_matches(s, 'cross[- ]source|several sources|multiple sources') THEN 0.15::DOUBLE ELSE 0::DOUBLE END), 4) AS confidence FROM q""")
def _(t):
    q = t("conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, " emails of the last 3 days").otherwise(" cross-source phone today")).alias("query"))
    return P.parse_queries(q).select("conv_id", "turn", "hours", "cross_source", "confidence")


@_q("dom_budget", "SELECT doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS spent, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 40000 AS granted FROM documents")
def _(t):
    running = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return t("documents").select("doc_id", running.alias("spent"), (running <= 40000).alias("granted"))


@register("dom_route_clue", f"WITH {ENTITIES} SELECT clue_id, CASE WHEN clue_quality >= 0.82 THEN 'skip_strong' WHEN clue_quality >= 0.5 AND n_sources >= 2 THEN 'refine' WHEN clue_quality >= 0.35 THEN 'collect_more' ELSE 'archive' END AS route FROM rated")
def dom_route_clue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).select("clue_id", P.refinement(F.col("clue_quality"), F.col("n_sources")).alias("route"))


@register("flt_quality_gate", f"WITH {ENTITIES} SELECT clue_id FROM rated WHERE clue_quality >= 0.65 AND n_sources >= 2 AND n_traces >= 2")
def flt_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).where("clue_quality >= 0.65 AND n_sources >= 2 AND n_traces >= 2").select("clue_id")


@register("topk_clue_rank", f"WITH {ENTITIES} SELECT clue_id, clue_quality FROM rated ORDER BY clue_quality DESC, n_traces DESC, clue_id LIMIT 10")
def topk_clue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).orderBy(F.desc("clue_quality"), F.desc("n_traces"), "clue_id").select("clue_id", "clue_quality").limit(10)


#: Elements of a playbook and the terms that show them, in invented prose.
_ELEMENTS = {"accounts": ("password", "account", "token"), "contact": ("mail2.example.com", "mail5.example.com", "+1 ("), "prose": ("the", "und", "que", "les"), "tools": ("akia", "server", "script")}
_shown = " UNION ALL ".join(f"SELECT risk_category, '{e}' AS element, '{t}' AS term FROM held WHERE {_term_sql(t)}" for e, terms in _ELEMENTS.items() for t in terms)


@register("agg_playbook", f"""WITH {ENTITIES}, members AS (SELECT DISTINCT c.risk_category, e.trace_id FROM clues c JOIN entities e ON e.normalized = c.key AND 'shared_' || e.entity_type = c.clue_type),
held AS (SELECT risk_category, trace_id, lower(t) AS low FROM members JOIN base USING (trace_id)), shown AS (SELECT DISTINCT * FROM ({_shown})),
k AS (SELECT risk_category, count(DISTINCT clue_id) AS clue_count FROM clues GROUP BY 1 HAVING count(DISTINCT clue_id) >= 2), n AS (SELECT risk_category, count(*) AS evidence_count FROM members GROUP BY 1),
p AS (SELECT risk_category, element, string_agg(term, ',' ORDER BY term) AS terms FROM shown GROUP BY 1, 2), q AS (SELECT risk_category, count(*) AS m, string_agg(element || '=' || terms, ';' ORDER BY element) AS elements FROM p GROUP BY 1 HAVING count(*) >= 2)
SELECT risk_category, clue_count, evidence_count, elements, round(least(0.96::DOUBLE, 0.58::DOUBLE + 0.07::DOUBLE * clue_count + 0.04::DOUBLE * m), 4) AS confidence FROM k JOIN q USING (risk_category) JOIN n USING (risk_category)""")
def agg_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(clues(spark, sf_dir).select("clue_id", "risk_category"), "playbook-clues")
    named = entities(spark, sf_dir).select(G.clue_id(F.concat(F.lit("shared_"), "entity_type"), F.col("normalized")).alias("clue_id"), "trace_id")
    evidence = materialise(named.join(found.select("clue_id"), "clue_id", "left_semi"), "playbook-evidence")
    books = P.playbooks(found, evidence, R.records(table(spark, sf_dir, "documents")).select("trace_id", F.col("clean_text").alias("text")), _ELEMENTS)
    shown = F.array_join(F.transform(F.map_entries("elements"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return books.select("risk_category", "clue_count", "evidence_count", shown.alias("elements"), "confidence")


@register("dom_reviewability", f"WITH {ENTITIES} SELECT clue_id, n_sources, n_traces, last_trace - first_trace AS span, CASE WHEN n_sources >= 2 AND n_traces >= 3 THEN 'review_now' WHEN n_traces >= 2 THEN 'sample_review' ELSE 'hold' END AS action FROM clues")
def dom_reviewability(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when((F.col("n_sources") >= 2) & (F.col("n_traces") >= 3), "review_now").when(F.col("n_traces") >= 2, "sample_review").otherwise("hold")
    return clues(spark, sf_dir).select("clue_id", "n_sources", "n_traces", (F.col("last_trace") - F.col("first_trace")).alias("span"), action.alias("action"))


@register("agg_account_tool_overlap", f"WITH {ENTITIES} SELECT trace_id, count(DISTINCT entity_type) AS kinds FROM entities GROUP BY 1 HAVING count(DISTINCT entity_type) >= 2")
def agg_account_tool_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).groupBy("trace_id").agg(F.countDistinct("entity_type").alias("kinds")).where("kinds >= 2")
