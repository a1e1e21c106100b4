"""Matching, retrieval and evaluation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.operators import matching as M
from clueforge.operators import records as R
from clueforge.plans.graph_queries import ENTITIES, clues, entities
from clueforge.plans.record_queries import CLASSIFIED, classified
from clueforge.plans.relational_queries import _q
from clueforge.registry import register
from clueforge.session import materialise, table


@register("dom_dedup_near")
def dom_dedup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(R.records(table(spark, sf_dir, "documents")))


@register("dom_cluster_template")
def dom_cluster_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(R.records(table(spark, sf_dir, "documents")), M.TEMPLATE)


#: Expected clues from the labels (toxic documents by source and language), actual ones from the rules that hit the texts; both for each source and language.
_SIDES = f"""{CLASSIFIED}, gold AS (SELECT source || '/' || lang AS id, source AS key, lang AS risk, list(doc_id::VARCHAR) AS evidence FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
hits AS (SELECT b.source_name || ':' || d.lang AS id, b.source_name AS key, d.lang AS risk, list(trace_id::VARCHAR) AS evidence FROM bucketed b JOIN documents d ON d.doc_id = b.trace_id WHERE hit_insult > 0 AND source_name IS NOT NULL AND d.lang IS NOT NULL GROUP BY ALL),
paired AS (SELECT g.id AS expected, h.id AS actual, len(list_intersect(g.evidence, h.evidence)) AS shared,
  2 + CASE WHEN contains(g.key, h.key) OR contains(h.key, g.key) THEN 4 ELSE 0 END + CASE WHEN g.risk = h.risk THEN 2 ELSE 0 END + CASE WHEN g.key = h.key THEN 3 ELSE 0 END + CASE WHEN len(list_intersect(g.evidence, h.evidence)) > 0 THEN 2 + len(list_intersect(g.evidence, h.evidence)) ELSE 0 END AS score
  FROM gold g JOIN hits h ON contains(g.key, h.key) OR contains(h.key, g.key)),
turns AS (SELECT expected, row_number() OVER (ORDER BY expected) AS turn FROM (SELECT DISTINCT expected FROM paired)),
chosen AS (SELECT turn, expected, list({{'less': -score, 'actual': actual, 'shared': shared}} ORDER BY -score, actual) AS wants FROM paired JOIN turns USING (expected) GROUP BY ALL),
walk AS (SELECT 0::BIGINT AS turn, []::VARCHAR[] AS used, NULL::VARCHAR AS expected, NULL::STRUCT(less INTEGER, actual VARCHAR, shared BIGINT) AS got
  UNION ALL SELECT c.turn, CASE WHEN len(list_filter(wants, lambda w: NOT list_contains(used, w.actual))) > 0 THEN list_append(used, list_filter(wants, lambda w: NOT list_contains(used, w.actual))[1].actual) ELSE used END, c.expected, list_filter(wants, lambda w: NOT list_contains(used, w.actual))[1]
  FROM walk JOIN chosen c ON c.turn = walk.turn + 1),
matches AS (SELECT expected, got.actual AS actual, -got.less AS score, got.shared AS shared FROM walk WHERE got IS NOT NULL)"""


def clue_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    named = lambda df, sign: df.where("source IS NOT NULL AND lang IS NOT NULL").groupBy(F.concat("source", F.lit(sign), "lang").alias("id"), F.col("source").alias("key"), F.col("lang").alias("risk_category")).agg(F.collect_set("doc_id").alias("evidence")).withColumns({"clue_type": F.lit("insults_of_source"), "entities": F.array("key")})
    hit = classified(spark, sf_dir).where("hit_insult > 0").select(F.col("trace_id").alias("doc_id"))
    gold = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return named(docs.join(gold, "doc_id", "left_semi"), "/"), named(docs.join(hit, "doc_id", "left_semi"), ":")


def matched_clues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expected clues, actual clues and the matches between them with their common records."""
    expected, actual = (materialise(x, "clue-side") for x in clue_sides(spark, sf_dir))
    scores = materialise(M.clue_scores(expected, actual), "clue-scores")
    found = M.greedy_matches(scores).join(scores.select("left", "right", "shared"), ["left", "right"])
    return expected, actual, found


@register("join_clue_match", f"WITH RECURSIVE {_SIDES} SELECT expected, actual, score::BIGINT AS score, shared FROM matches")
def join_clue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_clues(spark, sf_dir)[2].select(F.col("left").alias("expected"), F.col("right").alias("actual"), "score", "shared")


_normal = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), '[\s\x{A0}\x{85}]+', ' ', 'g'))"


@_q("dom_embed", rf"""WITH c AS (SELECT doc_id, regexp_replace(lower({_normal}), '[^\p{{L}}\p{{N}}]', '', 'g') AS c, lower({_normal}) AS t FROM documents), w AS (
  SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(c), 2)), lambda i: c[i:i + 1])) AS token FROM c WHERE c <> '' UNION ALL SELECT doc_id, unnest(list_filter(string_split(regexp_replace(t, '[/:]', ' ', 'g'), ' '), lambda x: x <> '')) FROM c WHERE c <> '') GROUP BY 1, 2
) SELECT doc_id, token, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 8) AS weight FROM w""")
def _(t):
    return M.embed(t("documents")).select("doc_id", "token", F.round("weight", 8).alias("weight"))


@_q("topk_dense", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, vec_id LIMIT 10")
def _(t):
    from functools import reduce

    q = F.broadcast(t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("e")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    rows = t("embeddings").crossJoin(q)
    cosine = F.round(dot(F.col("embedding"), F.col("e")) / reduce(lambda a, b: a * b, [F.sqrt(dot(F.col(c), F.col(c))) for c in ("embedding", "e")]), 6)
    return rows.select("vec_id", cosine.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


@register("topk_graph_retrieve", f"WITH {ENTITIES} SELECT entity_id, round(0.22::DOUBLE + 0.12::DOUBLE * least(count(DISTINCT trace_id), 5), 4) AS score FROM entities WHERE entity_type IN ('email', 'domain') GROUP BY 1 ORDER BY score DESC, entity_id LIMIT 20")
def topk_graph_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = entities(spark, sf_dir).where("entity_type IN ('email', 'domain')").groupBy("entity_id").agg(F.countDistinct("trace_id").alias("k"))
    return per.select("entity_id", F.round(0.22 + 0.12 * F.least("k", F.lit(5)), 4).alias("score")).orderBy(F.desc("score"), "entity_id").limit(20)


@register("agg_graph_clue", f"""WITH {ENTITIES}, near AS (SELECT src AS entity_id, dst AS other FROM relations UNION ALL SELECT dst, src FROM relations), kinds AS (SELECT entity_id, bool_or(other LIKE 'entity:phone:%') AS phone, bool_or(other LIKE 'entity:ip:%') AS ip FROM near GROUP BY 1), wide AS (SELECT entity_id, count(DISTINCT source_name) AS n_sources FROM entities GROUP BY 1 HAVING count(DISTINCT source_name) >= 2)
SELECT entity_id, n_sources, CASE WHEN phone THEN 'graph_contact' WHEN ip THEN 'graph_network' ELSE 'graph_shared' END AS clue_type FROM wide LEFT JOIN kinds USING (entity_id)""")
def agg_graph_clue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clueforge.operators.graph import cooccurrence

    found = entities(spark, sf_dir)
    relations = cooccurrence(found)
    near = relations.select(F.col("src").alias("entity_id"), F.col("dst").alias("other")).union(relations.select("dst", "src"))
    kinds = near.groupBy("entity_id").agg(F.bool_or(F.col("other").startswith("entity:phone:")).alias("phone"), F.bool_or(F.col("other").startswith("entity:ip:")).alias("ip"))
    wide = found.groupBy("entity_id").agg(F.countDistinct("source_name").alias("n_sources")).where("n_sources >= 2")
    return wide.join(kinds, "entity_id", "left").select("entity_id", "n_sources", F.when(F.col("phone"), "graph_contact").when(F.col("ip"), "graph_network").otherwise("graph_shared").alias("clue_type"))


@register("agg_evidence_pr", f"""WITH RECURSIVE {_SIDES}, n AS (SELECT count(*) AS tp, coalesce(sum(shared), 0) AS both_sides, coalesce(sum(len(g.evidence)), 0) AS e, coalesce(sum(len(h.evidence)), 0) AS a FROM matches m JOIN gold g ON g.id = m.expected JOIN hits h ON h.id = m.actual)
SELECT tp, (SELECT count(*) FROM hits) - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn, CASE WHEN a > 0 THEN round(both_sides / a, 4) ELSE 0 END AS evidence_precision, CASE WHEN e > 0 THEN round(both_sides / e, 4) ELSE 0 END AS evidence_recall FROM n""")
def agg_evidence_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual, found = matched_clues(spark, sf_dir)
    size = lambda df, name, end: df.select(F.col("id").alias(name), F.size("evidence").alias(end))
    sums = found.join(size(expected, "left", "e"), "left").join(size(actual, "right", "a"), "right").agg(F.count("*").alias("tp"), F.coalesce(F.sum("shared"), F.lit(0)).alias("k"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    rate = lambda n: F.coalesce(F.round(F.try_divide(F.col("k").cast("double"), F.col(n).cast("double")), 4), F.lit(0.0))
    n_e, n_a = expected.count(), actual.count()
    return sums.select("tp", (F.lit(n_a) - F.col("tp")).cast("long").alias("fp"), (F.lit(n_e) - F.col("tp")).cast("long").alias("fn"), rate("a").alias("evidence_precision"), rate("e").alias("evidence_recall"))


@register("agg_profile_dataset", f"WITH {CLASSIFIED} SELECT source_name, risk_category, review_bucket, count(*) AS n FROM bucketed GROUP BY GROUPING SETS ((source_name), (risk_category), (review_bucket), (source_name, risk_category))")
def agg_profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classified(spark, sf_dir)
    sets = [["source_name"], ["risk_category"], ["review_bucket"], ["source_name", "risk_category"]]
    return df.groupingSets(sets, "source_name", "risk_category", "review_bucket").agg(F.count("*").alias("n"))


@register("rep_difficult_sets", f"WITH {CLASSIFIED} SELECT CASE WHEN t = '' THEN 'blank' WHEN length(t) < 500 THEN 'short' WHEN n_categories >= 3 THEN 'mixed' ELSE 'plain' END AS subset, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, round(avg(review_required::INT), 4) AS review_rate FROM bucketed GROUP BY 1")
def rep_difficult_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classified(spark, sf_dir)
    subset = F.when(F.col("clean_text") == "", "blank").when(F.length("clean_text") < 500, "short").when(F.col("n_categories") >= 3, "mixed").otherwise("plain")
    return df.groupBy(subset.alias("subset")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.avg(F.col("review_required").cast("int")), 4).alias("review_rate"))


@_q("fn_levenshtein", "SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDINGS') AS distance FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.levenshtein("c_mktsegment", F.lit("BUILDINGS")).cast("long").alias("distance"))


@_q("src_ocr_conf", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value / 100 WHEN event_id % 3 = 1 THEN value / 100 END, 4) AS confidence FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("%"))).when(F.col("event_id") % 3 == 1, (F.col("value") / 100).cast("string")).otherwise("n/a")
    number = F.regexp_replace(raw, "%$", "").try_cast("double")
    return t("events").select("event_id", F.round(F.when(raw.endswith("%"), number / 100).otherwise(number), 4).alias("confidence"))


@_q("svc_local_lookup", "SELECT doc_id, hits FROM (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['und', 'der', 'que', 'les', 'the'])) AS hits FROM documents) ORDER BY hits DESC, doc_id LIMIT 15")
def _(t):
    from clueforge.functions import text as T

    hits = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, ("und", "der", "que", "les", "the"))))).cast("long")
    return t("documents").select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(15)


@_q("svc_report", "SELECT lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, round(avg(n_chars), 2) AS avg_chars, quantile_disc(n_chars, 0.5) AS median FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.round(F.avg("n_chars"), 2).alias("avg_chars"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("median"))


@_q("rep_gold_merge", "SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, nullif(d.lang, ''), 'none') AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "good"), F.nullif(F.col("lang"), F.lit("")), F.lit("none")).alias("value"))


@_q("rep_gold_validate", "SELECT count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS without_text, count(*) FILTER (quality IS NULL) AS without_gold FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"), F.count_if(F.col("quality").isNull()).alias("without_gold"))


@_q("rep_source_smoke", "SELECT source, min(doc_id) AS representative FROM documents GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")).where("n >= 2").drop("n")
