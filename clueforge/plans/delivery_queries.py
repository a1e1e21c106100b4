"""Deliveries: landed files, selections, evaluations, reports and incremental state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.functions import text as T
from clueforge.operators import evaluation as E
from clueforge.operators import graph as G
from clueforge.operators import records as R
from clueforge.operators import selection as S
from clueforge.operators.retrieval import nearest, word_index
from clueforge.plans.clue_queries import objects, objects_sql
from clueforge.plans.graph_queries import ENTITIES, clues, entities, rated
from clueforge.plans.mention_queries import ADVANCED, TERMS
from clueforge.plans.record_queries import CLASSIFIED, classified
from clueforge.plans.relational_queries import _q
from clueforge.operators import mentions as M
from clueforge.registry import register
from clueforge.session import materialise, table
from clueforge.sources import landing as L
from clueforge.streaming import cursors, streams
from clueforge.streaming.incremental import merged_state
from clueforge.streaming.pending import Pending


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("src_jsonl", "SELECT doc_id, sha1(text) AS digest, source, false AS bad FROM documents")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = L.scratch(spark, "jsonl")
    L.export(docs(spark, sf_dir), path, "jsonl")
    found = L.read_jsonl(spark, path, "doc_id long, text string, source string")
    return found.select("doc_id", F.sha1("text").alias("digest"), "source", F.col("bad_line").isNotNull().alias("bad"))


@register("sink_csv", "SELECT doc_id, lang, source, n_chars FROM documents")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = L.scratch(spark, "csv")
    L.export(docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), path, "csv")
    return spark.read.schema("doc_id long, lang string, source string, n_chars long").option("header", True).option("escape", '"').csv(path)


@register("sink_jsonl", "SELECT conv_id, turn, role, sha1(text) AS digest FROM conversations")
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = L.scratch(spark, "json")
    L.export(table(spark, sf_dir, "conversations"), path, "jsonl")
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path).select("conv_id", "turn", "role", F.sha1("text").alias("digest"))


@register("sink_sql", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def sink_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = L.scratch(spark, "upsert")
    L.upsert_table(rows.where("event_id % 2 = 0"), path, ["user_id"], ["event_id"])
    return L.upsert_table(rows.where("event_id % 2 = 1"), path, ["user_id"], ["event_id"])


@register("sink_graph", f"WITH {ENTITIES} SELECT entity_id, count(DISTINCT trace_id) AS n_traces, min(trace_id) AS first_trace FROM entities GROUP BY 1")
def sink_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = L.scratch(spark, "graph")
    found = entities(spark, sf_dir)
    L.export(found.select("entity_id", "trace_id", "source_name"), f"{path}/observations", "parquet")
    return spark.read.parquet(f"{path}/observations").groupBy("entity_id").agg(F.countDistinct("trace_id").alias("n_traces"), F.min("trace_id").alias("first_trace"))


@register("src_html_results")
def src_html_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_results(table(spark, sf_dir, "pages"))


@register("src_hydrate", """WITH r AS (SELECT doc_id, 'u' || doc_id AS url, text[1:60] AS snippet FROM documents), f AS (SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 'short' ELSE text END AS body, CASE WHEN doc_id % 7 = 0 THEN 500 ELSE 200 END AS status FROM documents WHERE doc_id % 3 > 0),
h AS (SELECT doc_id, snippet, trim(body) AS body, CASE WHEN f.url IS NULL THEN 'not_fetched' WHEN status <> 200 THEN 'fetch_failed' WHEN length(trim(coalesce(body, ''))) < 40 THEN 'too_short' ELSE 'hydrated' END AS hydration FROM r LEFT JOIN f USING (url))
SELECT doc_id, hydration, sha1(CASE WHEN hydration = 'hydrated' THEN body ELSE snippet END) AS digest FROM h""")
def src_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, url = docs(spark, sf_dir), F.concat(F.lit("u"), F.col("doc_id"))
    fetched = d.where("doc_id % 3 > 0").select(url.alias("url"), F.when(F.col("doc_id") % 5 == 0, "short").otherwise(F.col("text")).alias("body"), F.when(F.col("doc_id") % 7 == 0, 500).otherwise(200).alias("status"))
    found = L.hydrate(d.select("doc_id", url.alias("url"), F.substring("text", 1, 60).alias("snippet")), fetched)
    return found.select("doc_id", "hydration", F.sha1("content_text").alias("digest"))


@_q("prj_context_copy", "SELECT d.doc_id AS trace_id, source, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels"), "doc_id", "left").withColumnRenamed("doc_id", "trace_id")


@register("prj_corpus_seed", f"WITH {CLASSIFIED} SELECT trace_id, round(risk_score * 0.5::DOUBLE + quality_score * 0.3::DOUBLE + least(n_markers, 5) * 0.04::DOUBLE, 6) AS priority FROM bucketed WHERE drop_reason IS NULL AND n_categories > 0 ORDER BY round(risk_score * 0.5::DOUBLE + quality_score * 0.3::DOUBLE + least(n_markers, 5) * 0.04::DOUBLE, 6) DESC, trace_id LIMIT 50")
def prj_corpus_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("risk_score") * 0.5 + F.col("quality_score") * 0.3 + F.least("n_markers", F.lit(5)) * 0.04, 6)
    return classified(spark, sf_dir).where("drop_reason is null and n_categories > 0").select("trace_id", score.alias("priority")).orderBy(F.desc("priority"), "trace_id").limit(50)


@_q("join_followup", "SELECT c.conv_id, c.turn, max(a.turn) AS anchor FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn < c.turn AND a.role <> c.role GROUP BY ALL")
def _(t):
    rows = t("conversations").select("conv_id", "turn", "role")
    # The last turn of another role: that before the run of turns of this role.
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag(F.struct("turn", "role")).over(w)
    rows = rows.withColumn("before", before)
    other = F.last(F.when(F.col("before.role") != F.col("role"), F.col("before.turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", other.alias("anchor"))


@register("win_strict_balance", """WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT max(x) AS total FROM range(1, (SELECT sum(n)::BIGINT + 1 FROM n)) r(x) WHERE (SELECT sum(least(n, floor(0.08 * x + 1e-9)::BIGINT)) FROM n) >= x),
c AS (SELECT source, least(n, floor(0.08 * total + 1e-9)::BIGINT) AS most, total FROM n, t), g AS (SELECT source, least(most, greatest(0, total - coalesce(sum(most) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS most FROM c)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) JOIN g USING (source) WHERE place <= most""")
def win_strict_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strict_balance(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 0.08)


@register("win_quota_select")
def win_quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of page addresses, a class for each last character of the host."""
    host = T.domain_of(F.col("url"))
    rows = table(spark, sf_dir, "pages").groupBy(host.alias("name")).agg(F.min("page_id").alias("position"), F.min("url").alias("url"), F.count("*").alias("n"))
    rows = rows.select("position", "name", "url", F.lit("").alias("query"), F.right("name", F.lit(3)).alias("cls"), F.array(F.when(F.col("n") > 5, "busy").otherwise("quiet")).alias("groups"))
    return S.quota_select(rows, 12, {"busy": 3, "quiet": 2}, 1)


@register("topk_source_select", """WITH s AS (SELECT source, lang, count(*) AS n, round(0.6::DOUBLE * least(count(*), 20) / 20 + 0.4::DOUBLE * avg((n_chars > 500)::INT), 6) AS score FROM documents GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) > 1 AS later FROM s)
SELECT source, lang, score, row_number() OVER (ORDER BY later, score DESC, source)::INT AS pick FROM p QUALIFY row_number() OVER (ORDER BY later, score DESC, source) <= 15""")
def topk_source_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 500).cast("int")).alias("long"))
    scored = rows.select("source", "lang", F.round(0.6 * F.least("n", F.lit(20)) / 20 + 0.4 * F.col("long"), 6).alias("score"))
    return S.diverse(scored, "lang", "score", "source", 15).select("source", "lang", "score", "pick")


@register("join_entity_match")
def join_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = R.records(docs(spark, sf_dir))
    gold = entities(spark, sf_dir).select("trace_id", F.when(F.col("entity_type") == "domain", "*").otherwise(F.col("entity_type")).alias("entity_type"), F.col("normalized").alias("value"))
    return E.entity_matches(gold, M.extract_advanced(base, TERMS).select("trace_id", "entity_type", F.col("normalized").alias("value")))


@register("agg_entity_exact", f"WITH {ADVANCED}, both_sides AS (SELECT count(*) FILTER (method = 'pattern') AS tp, count(*) FILTER (method <> 'pattern') AS fp FROM advanced) SELECT tp, fp, 0::BIGINT AS fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp > 0 THEN 1 ELSE 0 END, 4)::DOUBLE AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp) ELSE 0 END, 4)::DOUBLE AS f1 FROM both_sides")
def agg_entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.extract_advanced(R.records(docs(spark, sf_dir)), TERMS)
    counts = found.agg(F.count_if(F.col("method") == "pattern").alias("tp"), F.count_if(F.col("method") != "pattern").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return counts.withColumns(E.prf(F.col("tp"), F.col("fp"), F.col("fn")))


#: Expected are the clues of the documents that the labels call good, actual those of all documents.
_layer = "unnest(['overall', CASE WHEN starts_with(clue_type, 'entity_graph') THEN 'graph' ELSE 'standard' END]) AS layer"
_gold_only = "trace_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@register("agg_clue_layer", f"""WITH gold AS (WITH {objects_sql(_gold_only)} SELECT clue_type, count(*) AS n FROM objects GROUP BY 1), {objects_sql()},
w AS (SELECT clue_type, n, {_layer} FROM gold), g AS (SELECT clue_type, key, {_layer} FROM objects), a AS (SELECT layer, list(DISTINCT clue_type) AS found, count(*) AS actual, count(DISTINCT (clue_type, key)) AS kinds FROM g GROUP BY 1), e AS (SELECT layer, list(DISTINCT clue_type) AS wanted, sum(n)::BIGINT AS expected FROM w GROUP BY 1),
c AS (SELECT layer, len(list_intersect(wanted, found)) AS tp, len(found) - len(list_intersect(wanted, found)) + greatest(0, actual - greatest(expected, len(list_intersect(wanted, found)))) AS fp, len(wanted) - len(list_intersect(wanted, found)) + greatest(0, expected - actual) AS fn, actual, expected, kinds
  FROM (SELECT layer, coalesce(wanted, []) AS wanted, coalesce(found, []) AS found, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(kinds, 0) AS kinds FROM e FULL JOIN a USING (layer)))
SELECT layer, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, round(actual::DOUBLE / greatest(expected, 1), 4) AS overgeneration, round(actual * 100.0::DOUBLE / (SELECT greatest(count(*), 1) FROM documents), 4) AS per_hundred, round(1 - kinds::DOUBLE / greatest(actual, 1), 4) AS duplicate_rate FROM c""")
def agg_clue_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("trace_id"))
    gold = objects(spark, sf_dir, good).groupBy("clue_type").agg(F.count("*").alias("n"))
    return E.clue_layers(gold, objects(spark, sf_dir), docs(spark, sf_dir).count())


@register("rep_profile_curve", f"WITH {ENTITIES}, p AS (SELECT * FROM (VALUES ('balanced', 0.65::DOUBLE), ('high_precision', 0.78::DOUBLE), ('high_recall', 0.52::DOUBLE)) v(profile, least)) SELECT profile, count(*) AS n, count(*) FILTER (clue_quality >= least) AS passed, round(avg(CASE WHEN clue_quality >= least THEN clue_quality END), 4) AS mean_passed FROM rated, p GROUP BY 1")
def rep_profile_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(x).alias("least")) for n, x in (("balanced", 0.65), ("high_precision", 0.78), ("high_recall", 0.52))])
    rows = rated(spark, sf_dir).select("clue_quality", F.explode(profiles).alias("p"))
    ok = F.col("clue_quality") >= F.col("p.least")
    return rows.groupBy(F.col("p.profile").alias("profile")).agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.round(F.avg(F.when(ok, F.col("clue_quality"))), 4).alias("mean_passed"))


@register("rep_eval_gain", """WITH m AS (SELECT doc_id % 2 AS run, source AS metric, avg(n_chars) AS value FROM documents GROUP BY 1, 2) SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 4) AS gain FROM (SELECT * FROM m WHERE run = 0) a FULL JOIN (SELECT * FROM m WHERE run = 1) b USING (metric)""")
def rep_eval_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = lambda n: docs(spark, sf_dir).where(F.col("doc_id") % 2 == n).groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    return E.gains(report(0), report(1))


@_q("rep_ocr_quality", "WITH r AS (SELECT CASE item_id % 2 WHEN 0 THEN 'glyph' ELSE 'cli' END AS engine, text AS gold, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 3 = 0 THEN replace(text, 'e', 'c') ELSE text END AS found FROM benchmark) SELECT engine, count(*) AS n, count(*) FILTER (found IS NULL) AS errors, round(avg((coalesce(found = gold, false))::INT), 4) AS exact_rate, round(avg(round(coalesce(1 - levenshtein(found, gold)::DOUBLE / greatest(length(found), length(gold), 1), 0.0::DOUBLE), 4)), 4) AS character_rate FROM r GROUP BY 1")
def _(t):
    i = F.col("item_id")
    rows = t("benchmark").select(F.when(i % 2 == 0, "glyph").otherwise("cli").alias("engine"), F.col("text").alias("gold"), F.when(i % 5 == 0, None).when(i % 3 == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text")).alias("found"))
    rows = rows.withColumns(E.text_match(F.col("found"), F.col("gold")))
    return rows.groupBy("engine").agg(F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("errors"), F.round(F.avg(F.col("exact").cast("int")), 4).alias("exact_rate"), F.round(F.avg("characters"), 4).alias("character_rate"))


@_q("rep_gold_export", "SELECT doc_id AS trace_id, source AS source_name, CASE WHEN length(text) <= 160 THEN text ELSE text[1:157] || '...' END AS excerpt, quality, toxic, '' AS reviewer, 'pending' AS status FROM documents JOIN labels USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").alias("trace_id"), F.col("source").alias("source_name"), T.excerpt(F.col("text")).alias("excerpt"), "quality", "toxic", F.lit("").alias("reviewer"), F.lit("pending").alias("status"))


@_q("rep_acceptance_sample", "SELECT lang, doc_id, ready FROM (SELECT lang, doc_id, l.doc_id IS NOT NULL AS ready FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY (NOT ready)::INT, doc_id) <= 25")
def _(t):
    gold = t("labels").select("doc_id", F.lit(True).alias("ready"))
    rows = t("documents").select("lang", "doc_id").join(gold, "doc_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    return S.ranked(rows, "lang", [(~F.col("ready")).cast("int"), F.col("doc_id")]).where("place <= 25").select("lang", "doc_id", "ready")


@_q("rep_balanced_external", "WITH k AS (SELECT doc_id, lang, source, CASE WHEN lang IS NULL OR source IS NULL THEN 'missing_field' WHEN n_chars < 200 THEN 'too_short' END AS skip FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM k WHERE skip IS NULL), p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM r) SELECT 'kept' AS state, lang, count(*) AS n, min(doc_id) AS first FROM p WHERE place <= 30 GROUP BY ALL UNION ALL SELECT skip, lang, count(*), min(doc_id) FROM k WHERE skip IS NOT NULL GROUP BY ALL")
def _(t):
    skip = F.when(F.col("lang").isNull() | F.col("source").isNull(), "missing_field").when(F.col("n_chars") < 200, "too_short")
    rows = t("documents").select("doc_id", "lang", "source", skip.alias("skip"))
    kept = rows.where("skip is null").withColumn("turn", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")))
    kept = S.ranked(kept, "lang", [F.col("turn"), F.col("source")]).where("place <= 30").select(F.lit("kept").alias("state"), "lang", "doc_id")
    both = kept.unionByName(rows.where("skip is not null").select(F.col("skip").alias("state"), "lang", "doc_id"))
    return both.groupBy("state", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@_q("rep_rerun_pack", "SELECT source, count(*) AS n, count(*) FILTER (lang IS NOT NULL) AS claimable, count(*) FILTER (l.doc_id IS NOT NULL) AS with_snapshot, round(count(*) FILTER (l.doc_id IS NOT NULL)::DOUBLE / count(*), 4) AS coverage, min(d.doc_id) AS first, max(d.doc_id) AS last FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(t):
    gold = t("labels").select("doc_id", F.lit(1).alias("there"))
    there = F.count("there")
    return t("documents").select("doc_id", "source", "lang").join(gold, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("claimable"), there.alias("with_snapshot"), F.round(there / F.count("*"), 4).alias("coverage"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@_q("rep_slang_overlay", "WITH base AS (SELECT source AS term, min(lang) AS plain FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), fresh AS (SELECT source AS term, lang AS plain, doc_id AS seq FROM documents WHERE doc_id % 3 = 0), f AS (SELECT term, arg_min(plain, seq) AS plain, count(*) - 1 AS repeats FROM fresh GROUP BY 1) SELECT f.term, f.plain, repeats, b.plain AS known, CASE WHEN b.plain IS NULL THEN 'added' WHEN b.plain = f.plain THEN 'same' ELSE 'conflict' END AS status FROM f LEFT JOIN base b USING (term)")
def _(t):
    d = t("documents")
    base = d.where("doc_id % 2 = 0").groupBy(F.col("source").alias("term")).agg(F.min("lang").alias("plain"))
    return E.overlay(base, d.where("doc_id % 3 = 0").select(F.col("source").alias("term"), F.col("lang").alias("plain"), F.col("doc_id").alias("seq")))


@_q("rep_slang_review", "SELECT doc_id AS term_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'REVIEWED' WHEN quality = 1 THEN 'GRAY' WHEN toxic = 1 THEN 'REJECTED' ELSE 'NEW' END AS stage, quality = 1 OR toxic = 1 AS decided FROM labels")
def _(t):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return t("labels").select(F.col("doc_id").alias("term_id"), F.when(q & ~x, "REVIEWED").when(q, "GRAY").when(x, "REJECTED").otherwise("NEW").alias("stage"), (q | x).alias("decided"))


@register("dom_semantic_search", f"""WITH {ENTITIES}, q AS (SELECT unnest(['token', 'password', 'mail', 'the']) AS token), w AS (SELECT trace_id, token, count(*) AS n FROM (SELECT trace_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM base) GROUP BY ALL), s AS (SELECT trace_id, sum(n) FILTER (token IN (SELECT token FROM q)) / sqrt(sum(n * n)) AS score FROM w GROUP BY 1),
top AS (SELECT trace_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, trace_id LIMIT 10), near AS (SELECT DISTINCT b.trace_id FROM top JOIN entities a USING (trace_id) JOIN entities b ON a.entity_id = b.entity_id AND b.trace_id NOT IN (SELECT trace_id FROM top))
SELECT trace_id, score, 'vector' AS origin FROM top UNION ALL SELECT trace_id, NULL, 'graph' FROM near""")
def dom_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(T.tokens(F.col("clean_text")), lambda w: w.rlike("^[a-z0-9]+$"))
    index = word_index(R.records(docs(spark, sf_dir)).select(F.col("trace_id").alias("id"), "clean_text"), words)
    top = materialise(nearest(index, dict.fromkeys(("token", "password", "mail", "the"), 1.0), 10).select(F.col("id").alias("trace_id"), "score"), "nearest")
    found = entities(spark, sf_dir).select("trace_id", "entity_id")
    held = found.join(F.broadcast(top.select("trace_id")), "trace_id", "left_semi").select("entity_id").distinct()
    near = found.join(held, "entity_id", "left_semi").select("trace_id").distinct().join(F.broadcast(top.select("trace_id")), "trace_id", "left_anti")
    return top.select("trace_id", "score", F.lit("vector").alias("origin")).unionByName(near.select("trace_id", F.lit(None).cast("double").alias("score"), F.lit("graph").alias("origin")))


@register("dom_evidence_gap", f"WITH {ENTITIES}, s AS (SELECT risk_category, count(*) AS n, max(n_sources) AS sources, max(n_traces) AS traces, max(avg_confidence) AS confidence FROM clues GROUP BY 1) SELECT risk_category, array_to_string(list_filter([CASE WHEN n < 3 THEN 'too_few_clues' END, CASE WHEN sources < 3 THEN 'single_source_evidence' END, CASE WHEN traces < 3 THEN 'thin_evidence' END, CASE WHEN confidence < 0.76 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS gaps FROM s")
def dom_evidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clues(spark, sf_dir).groupBy("risk_category").agg(F.count("*").alias("n"), F.max("n_sources").alias("sources"), F.max("n_traces").alias("traces"), F.max("avg_confidence").alias("confidence"))
    gaps = F.array_compact(F.array(F.when(F.col("n") < 3, "too_few_clues"), F.when(F.col("sources") < 3, "single_source_evidence"), F.when(F.col("traces") < 3, "thin_evidence"), F.when(F.col("confidence") < 0.76, "low_confidence")))
    return s.select("risk_category", F.array_join(gaps, ",").alias("gaps"))


@register("dom_explore", f"WITH {CLASSIFIED} SELECT trace_id, CASE WHEN n_markers >= 3 THEN 'NEW_SLANG' WHEN has_contact THEN 'NEW_ENTITY_LINK' ELSE 'NEW_PATTERN' END AS hypothesis, round(least(0.8::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * n_markers), 4) AS confidence, true AS requires_human_review FROM bucketed WHERE review_bucket = 'manual'")
def dom_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_markers") >= 3, "NEW_SLANG").when(F.col("has_contact"), "NEW_ENTITY_LINK").otherwise("NEW_PATTERN")
    return classified(spark, sf_dir).where("review_bucket = 'manual'").select("trace_id", kind.alias("hypothesis"), F.round(F.least(F.lit(0.8), 0.4 + 0.1 * F.col("n_markers")), 4).alias("confidence"), F.lit(True).alias("requires_human_review"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parque[t]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@register("st_graph_state", f"WITH {ENTITIES} SELECT entity_id, sum(n)::BIGINT AS mentions, min(trace_id) AS first_trace, max(trace_id) AS last_trace FROM entities GROUP BY 1")
def st_graph_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda batch: G.extract(R.records(batch)).select("entity_id", F.col("n").alias("mentions"), F.col("trace_id").alias("first_trace"), F.col("trace_id").alias("last_trace"))
    return merged_state(_stream(spark, sf_dir, "documents"), found, ["entity_id"], {"mentions": "sum", "first_trace": "min", "last_trace": "max"})


@register("st_dedup_state", f"WITH {CLASSIFIED} SELECT dedup_group, min(trace_id) AS first_trace, count(*) AS copies FROM bucketed GROUP BY 1")
def st_dedup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lambda batch: R.records(batch).select(T.dedup_id(F.col("clean_text")).alias("dedup_group"), F.col("trace_id").alias("first_trace"), F.lit(1).cast("long").alias("copies"))
    return merged_state(_stream(spark, sf_dir, "documents"), keyed, ["dedup_group"], {"first_trace": "min", "copies": "sum"})


#: Rows of one build.
_DRAIN = 60


@register("st_pending_batch", f"""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events WHERE user_id IS NOT NULL),
k AS (SELECT user_id, min(i) AS first, arg_max(event_id, i) AS event_id, arg_max(value, i) AS value FROM e GROUP BY 1)
SELECT user_id, event_id, value, (row_number() OVER (ORDER BY first) - 1) // {_DRAIN} AS build FROM k""")
def st_pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffer = Pending(spark, L.scratch(spark, "pending"), "user_id long, event_id long, value double, at long", "user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    buffer.add(rows, ["at", "event_id"])
    out = materialise(buffer.drain_all(_DRAIN), "builds")
    first = out.agg(F.min("run")).collect()[0][0] or 0
    return out.select("user_id", "event_id", "value", (F.col("run") - F.lit(first)).alias("build"))


@register("src_chat_incremental", "SELECT conv_id::VARCHAR AS key, turn + 1 AS id, role, text FROM conversations WHERE turn >= 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn) = 1")
def src_chat_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, place = cursors.chat_messages(_stream(spark, sf_dir, "conversations")), L.scratch(spark, "chat")
    cursors.collect_new(stream, place)
    return cursors.collected(spark, stream.schema, place).select("key", "id", "role", "text")


@register("src_recent_search", "SELECT sha256(event_type)[1:16] AS key, event_id AS id, user_id, value FROM events WHERE event_id > 0 AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, event_id) = 1")
def src_recent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, place = cursors.search_results(_stream(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value"), "event_type", "event_id"), L.scratch(spark, "search")
    cursors.collect_new(stream, place)
    return cursors.collected(spark, stream.schema, place).select("key", "id", "user_id", "value")


@register("st_clue_batch", "SELECT user_id || ':' || json_extract_string(props, '$.k') AS key, count(*) AS n, min(event_type) AS least_type, max(event_type) AS most_type, min(event_type) <> max(event_type) AS cross_source FROM events GROUP BY 1")
def st_clue_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda batch: batch.select(F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("key"), F.lit(1).cast("long").alias("n"), F.col("event_type").alias("least_type"), F.col("event_type").alias("most_type"))
    state = merged_state(streams.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parque[t]"), rows, ["key"], {"n": "sum", "least_type": "min", "most_type": "max"})
    return state.withColumn("cross_source", F.col("least_type") != F.col("most_type"))
