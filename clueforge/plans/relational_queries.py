"""Relational, reporting, window and set queries over the data tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.functions import text as T
from clueforge.operators import relational as O
from clueforge.operators.quantiles import exact_quantiles
from clueforge.registry import register
from clueforge.session import table


def _q(name: str, sql: str | None):  # noqa: ANN202
    """Register a query written as a function of a table reader."""

    def wrap(build):  # noqa: ANN001, ANN202
        @register(name, sql)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda t: table(spark, sf_dir, t))

        return query

    return wrap


@_q("join_raw_cleaned", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(source, 'none') AS source FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("source", F.lit("none")).alias("source"))


@_q("join_expected_actual", "SELECT doc_id, quality, toxic, n_chars FROM labels LEFT JOIN documents USING (doc_id)")
def _(t):
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", "quality", "toxic", "n_chars")


@_q("join_new_rows", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@_q("join_semi", "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id", "source")


@_q("join_full", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "full").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@_q("join_evidence_pack", "SELECT d.doc_id, d.source, l.quality, c.turns, p.url FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id")
def _(t):
    turns = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    pages = t("pages").select(F.col("page_id").alias("doc_id"), "url")
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left").join(turns, "doc_id", "left").join(pages, "doc_id", "left")


@_q("join_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return O.latest(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@_q("join_clue_index", "SELECT source, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(t):
    gold = t("labels").select("doc_id", F.lit(True).alias("there"))
    return t("documents").join(gold, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


@_q("join_bridge_singletons", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.countDistinct("o_orderkey").alias("k")).where("k = 1").drop("k")


@_q("join_graph_hop", "SELECT DISTINCT a.o_custkey AS customer, b.l_suppkey AS supplier FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey ")
def _(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")).distinct()


@_q("join_range_48h", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT a.user_id, count(*) AS pairs FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 172800 GROUP BY 1")
def _(t):
    e = t("events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("s"))
    slot = F.floor(F.col("s") / 172800)
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("sa"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("sb"), slot.alias("slot"))
    near = a.join(b, ["user_id", "slot"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("sa") - F.col("sb")) <= 172800))
    return near.groupBy("user_id").agg(F.count("*").alias("pairs"))


@_q("agg_share", "SELECT source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY 1")
def _(t):
    return O.shares(t("documents"), "source")


@_q("agg_summary_rows", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(t):
    return t("documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@_q("agg_rollup", "SELECT lang, source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def _(t):
    return t("documents").rollup("lang", "source").agg(F.sum("n_chars").alias("chars"))


@_q("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_q("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@_q("agg_shared_contact_48h", "WITH k AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS key, event_id, event_type, CASE WHEN event_id % 11 > 0 THEN floor(epoch(ts))::BIGINT END AS s FROM events) SELECT key, count(DISTINCT event_id) AS n, count(DISTINCT event_type) AS sources, max(s) - min(s) AS span FROM k GROUP BY 1 HAVING count(DISTINCT event_id) >= 2 AND count(DISTINCT event_type) >= 2 AND coalesce(max(s) - min(s), 0) <= 172800")
def _(t):
    s = F.when(F.col("event_id") % 11 > 0, F.unix_seconds(F.col("ts").cast("timestamp")))
    k = t("events").select(F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("key"), "event_id", "event_type", s.alias("s"))
    return O.within(k, "key", "event_id", "event_type", "s", 172800).select("key", "n", "sources", "span")


@_q("agg_query_level", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1")
def _(t):
    e = t("events").select("event_type", "value")
    found = exact_quantiles(e, "event_type", "value", (0.5, 0.95)).groupBy("event_type").agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in ((0.5, "p50"), (0.95, "p95"))])
    return found.join(e.groupBy("event_type").agg(F.count("value").alias("n"), F.max("value").alias("worst")), "event_type")


@_q("agg_holdout", "SELECT source, CASE WHEN doc_id >= m - 100 THEN 'recent' WHEN doc_id >= m - 500 THEN 'middle' ELSE 'old' END AS bucket, count(*) AS n FROM documents, (SELECT max(doc_id) AS m FROM documents) GROUP BY 1, 2")
def _(t):
    newest = t("documents").agg(F.max("doc_id").alias("m"))
    bucket = F.when(F.col("doc_id") >= F.col("m") - 100, "recent").when(F.col("doc_id") >= F.col("m") - 500, "middle").otherwise("old")
    return t("documents").crossJoin(F.broadcast(newest)).groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@_q("agg_completeness", "SELECT lang, count(*) AS n, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (source IS NOT NULL) AS with_source, count(*) FILTER (n_chars = length(text)) AS right_size FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("with_text"), F.count_if(F.col("source").isNotNull()).alias("with_source"), F.count_if(F.col("n_chars") == F.length("text")).alias("right_size"))


@_q("agg_dashboard", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT arg_max(source, (n, source)) FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)) AS largest_source")
def _(t):
    docs = t("documents").groupBy("source").agg(F.count("*").alias("n")).agg(F.sum("n").alias("documents"), F.max_by("source", F.struct("n", "source")).alias("largest_source"))
    toxic = t("labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"))
    conv = t("conversations").agg(F.countDistinct("conv_id").alias("conversations"))
    return docs.crossJoin(F.broadcast(toxic)).crossJoin(F.broadcast(conv)).select("documents", "toxic", "conversations", "largest_source")


@_q("agg_ablation", "WITH r AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY 1), b AS (SELECT m FROM r WHERE lang = 'en') SELECT lang, round(r.m - b.m, 4) AS delta, round(r.m / nullif(b.m, 0), 4) AS ratio FROM r, b")
def _(t):
    r = t("documents").groupBy("lang").agg(F.avg("n_chars").alias("m"))
    b = r.where("lang = 'en'").select(F.col("m").alias("base"))
    return r.crossJoin(F.broadcast(b)).select("lang", F.round(F.col("m") - F.col("base"), 4).alias("delta"), F.round(F.try_divide("m", "base"), 4).alias("ratio"))


@_q("agg_scale", "SELECT l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def _(t):
    return t("lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("p50"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_q("win_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    return O.latest(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@_q("win_cap_by_type", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def _(t):
    return O.cap_by(t("events").select("event_type", "event_id", "value"), "event_type", [F.desc("value"), F.col("event_id")], 5)


@_q("win_quota_sample", "WITH a AS (SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) SELECT doc_id, source, lang FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 30")
def _(t):
    return O.quota_sample(t("documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 10, 30)


@_q("win_round_robin", "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id)::INT AS turn FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2")
def _(t):
    return O.round_robin(t("documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id").where("turn <= 2")


@_q("win_heldout_sample", "SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) <= 20")
def _(t):
    return t("labels").withColumn("k", F.row_number().over(Window.partitionBy("quality", "toxic").orderBy("doc_id"))).where("k <= 20").drop("k")


@_q("win_rolling_48h", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events)")
def _(t):
    e = t("events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-172800, 0)).alias("recent"))


@_q("win_rank_ntile", "SELECT c_custkey, (rank() OVER w)::INT AS place, (dense_rank() OVER w)::INT AS dense, (ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INT AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return t("customer").select("c_custkey", F.rank().over(w).alias("place"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("quarter"))


@_q("topk_candidate_sort", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(t):
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@_q("topk_review", "SELECT doc_id, round((2 * toxic + 1) / (0.5 + quality) * ln(1 + n_chars), 6) AS priority FROM labels JOIN documents USING (doc_id) ORDER BY round((2 * toxic + 1) / (0.5 + quality) * ln(1 + n_chars), 6) DESC, doc_id LIMIT 25")
def _(t):
    score = F.round((2 * F.col("toxic") + 1) / (0.5 + F.col("quality")) * F.log(1 + F.col("n_chars")), 6)
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", score.alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(25)


_QUERY = [("the", 2.0), ("password", 3.0), ("token", 3.0), ("que", 1.0)]


@_q("topk_vector", f"WITH q AS (SELECT * FROM (VALUES {', '.join(f'''('{a}', {b}::DOUBLE)''' for a, b in _QUERY)}) x(token, w)), w AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM w GROUP BY 1), d AS (SELECT doc_id, sum(n * w) AS dot FROM w JOIN q USING (token) GROUP BY 1) SELECT doc_id, round(dot / (norm * {sum(b * b for _, b in _QUERY) ** 0.5!r}), 6) AS score FROM d JOIN nm USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def _(t):
    return O.top_k_sparse(t("documents").select("doc_id", "text"), _QUERY, 20)


@_q("set_union_clues", "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def _(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")).unionByName(t("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


@_q("set_merge_clues", "WITH u AS (SELECT source, n_chars, doc_id AS trace, n_chars + doc_id % 7 AS score FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, n_chars, doc_id, n_chars FROM documents WHERE doc_id % 3 = 0) SELECT source, n_chars, array_to_string(list_sort(list_distinct(list(trace))), ',') AS traces, max(score) AS score FROM u GROUP BY 1, 2")
def _(t):
    d = t("documents").select("source", "n_chars", F.array("doc_id").alias("traces"), "doc_id")
    m = O.merge(d.where("doc_id % 2 = 0").withColumn("score", F.col("n_chars") + F.col("doc_id") % 7).drop("doc_id"), d.where("doc_id % 3 = 0").withColumn("score", F.col("n_chars")).drop("doc_id"), ["source", "n_chars"])
    return m.select("source", "n_chars", F.array_join(F.col("traces").cast("array<string>"), ",").alias("traces"), "score")


@_q("set_anti_existing", "SELECT doc_id, 'a' AS origin FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def _(t):
    a = t("documents").where("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("origin"))
    return O.anti_union(a, t("labels").select("doc_id", F.lit("b").alias("origin")), ["doc_id"])


@_q("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@_q("set_except", "SELECT lang FROM documents EXCEPT ALL SELECT lang FROM documents WHERE doc_id % 2 = 0")
def _(t):
    return t("documents").select("lang").exceptAll(t("documents").where("doc_id % 2 = 0").select("lang"))


@_q("set_source_candidates", "SELECT DISTINCT source, lang FROM documents")
def _(t):
    return t("documents").select("source", "lang").distinct()


@_q("flt_time_window", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 5 > 0 THEN ts - INTERVAL 1 HOUR END AS seen FROM events), (SELECT max(ts) AS m FROM events) WHERE seen IS NULL OR floor(epoch(m))::BIGINT - floor(epoch(seen))::BIGINT <= 172800")
def _(t):
    ts, i = F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id")
    e = t("events").select("event_id", F.when(i % 3 == 0, ts).alias("last_seen"), F.when(i % 5 > 0, ts - 3600).alias("updated_at"), ts.alias("s"))
    return e.crossJoin(F.broadcast(e.agg(F.max("s").alias("m")))).where(O.within_hours(["last_seen", "updated_at"], F.col("m"), 48)).select("event_id")


@_q("flt_in_list", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def _(t):
    return t("documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source")


@_q("flt_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(t):
    return t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@_q("fn_freshness", "SELECT event_id, CASE WHEN h <= 48 THEN 1.0::DOUBLE WHEN h <= 168 THEN 0.75::DOUBLE WHEN h <= 336 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS freshness FROM (SELECT event_id, (floor(epoch(TIMESTAMP '2024-02-01'))::BIGINT - floor(epoch(ts))::BIGINT) / 3600.0 AS h FROM events)")
def _(t):
    return t("events").select("event_id", T.freshness(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("freshness"))


@_q("fn_domain", "SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', '') AS domain FROM pages")
def _(t):
    return t("pages").select("page_id", T.domain_of(F.col("url")).alias("domain"))


@_q("fn_json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@_q("dom_followup", "SELECT conv_id, turn, lower(text) LIKE '%?%' AS asks, regexp_matches(lower(text), '^(and|more|what about|also)') AS follows FROM conversations WHERE role = 'user'")
def _(t):
    low = F.lower("text")
    return t("conversations").where("role = 'user'").select("conv_id", "turn", low.contains("?").alias("asks"), low.rlike("^(and|more|what about|also)").alias("follows"))


@_q("src_class", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' ELSE 'other' END AS scheme, CASE WHEN url LIKE '%blog.%' THEN 'social' WHEN url LIKE '%shop.%' THEN 'vertical' ELSE 'public' END AS source_class FROM pages")
def _(t):
    url = F.col("url")
    return t("pages").select("page_id", F.when(url.startswith("https://"), "secure").when(url.startswith("http://"), "plain").otherwise("other").alias("scheme"), F.when(url.contains("blog."), "social").when(url.contains("shop."), "vertical").otherwise("public").alias("source_class"))


@_q("src_metadata", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, coalesce(nullif(source, ''), 'unknown') || ':' || sha256(coalesce(text, ''))[1:12] AS snapshot_id FROM documents")
def _(t):
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return t("documents").select("doc_id", h.alias("content_hash"), F.concat_ws(":", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")), F.substring(h, 1, 12)).alias("snapshot_id"))


@_q("src_query_expand", "SELECT l.lang || ' ' || k.word AS query, row_number() OVER (ORDER BY l.lang, k.word)::INT AS place FROM (SELECT DISTINCT lang FROM documents) l, (VALUES ('token'), ('password')) k(word)")
def _(t):
    langs = t("documents").select("lang").distinct().withColumn("word", F.explode(F.array(F.lit("token"), F.lit("password"))))
    return langs.select(F.concat_ws(" ", "lang", "word").alias("query"), F.row_number().over(Window.orderBy("lang", "word")).alias("place"))


@_q("rep_relevance_refresh", "SELECT source, count(*) FILTER (a IS DISTINCT FROM b) AS changed FROM (SELECT source, contains(lower(text), 'the') AS a, regexp_matches(lower(text), '(^|[^a-z])the($|[^a-z])') AS b FROM documents) GROUP BY 1")
def _(t):
    low = F.lower("text")
    return t("documents").select("source", low.contains("the").alias("a"), low.rlike("(^|[^a-z])the($|[^a-z])").alias("b")).groupBy("source").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@_q("rep_gate", "SELECT lang, CASE WHEN count(*) < 150 THEN 'too_few_rows' END AS few, CASE WHEN avg(n_chars) < 2000 THEN 'too_short' END AS short FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("lang").agg(F.when(F.count("*") < 150, "too_few_rows").alias("few"), F.when(F.avg("n_chars") < 2000, "too_short").alias("short"))


@_q("rep_error_buckets", "SELECT bucket, doc_id FROM (SELECT CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic_quality' WHEN quality = 0 THEN 'low' ELSE 'fine' END AS bucket, doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY doc_id) <= 10")
def _(t):
    bucket = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "toxic_quality").when(F.col("quality") == 0, "low").otherwise("fine")
    return O.cap_by(t("labels").select(bucket.alias("bucket"), "doc_id"), "bucket", [F.col("doc_id")], 10)


@_q("pivot_roles", "SELECT turn, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY 1")
def _(t):
    return t("conversations").groupBy("turn").pivot("role", ["user", "assistant"]).count().na.fill(0).select("turn", F.col("user").alias("user_turns"), F.col("assistant").alias("assistant_turns"))
