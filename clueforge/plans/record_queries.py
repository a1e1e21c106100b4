"""Record-level queries over `documents` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import records as R
from clueforge.registry import register
from clueforge.rules import FIXTURE
from clueforge.session import table

_contains = lambda t: f"contains(lower(t), '{t.lower()}')"
_any = lambda terms: "(" + " OR ".join(map(_contains, terms)) + ")"
_hits = {c: "(" + " + ".join(f"{_contains(x)}::INT" for x in terms) + ")" for c, terms in FIXTURE.categories.items()}

#: The common table of all record-level columns.
CLEANED = rf"""
base AS (
  SELECT doc_id AS trace_id, coalesce(nullif(source, ''), 'unknown') AS source_name,
         trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'), '[\s\x{{A0}}\x{{85}}]+', ' ', 'g')) AS t
  FROM documents
), chars AS (
  SELECT trace_id, c, count(*) AS n FROM (SELECT trace_id, unnest(string_split(replace(t, ' ', ''), '')) AS c FROM base) WHERE c <> '' GROUP BY ALL
), stats AS (
  SELECT trace_id, sum(n) AS visible, coalesce(sum(n) FILTER (regexp_matches(c, '[\p{{L}}\p{{N}}]')), 0) AS signal, coalesce(sum(n) FILTER (c = chr(65533)), 0) AS broken,
         max(n) AS top, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM chars GROUP BY trace_id
), hit AS (
  SELECT base.*, coalesce(visible, 0) AS visible, coalesce(signal, 0)::BIGINT AS canonical_length, coalesce(broken, 0) AS broken, coalesce(top, 0) AS top, round(coalesce(entropy, 0), 4) AS text_entropy,
         {", ".join(f"{h} AS hit_{c}" for c, h in _hits.items())},
         regexp_matches(t, '{R.CONTACT}') AS has_contact, regexp_matches(t, '{R.URL}') AS has_url
  FROM base LEFT JOIN stats USING (trace_id)
), counted AS (
  SELECT *, {" + ".join(f"(hit_{c} > 0)::INT" for c in _hits)} AS n_categories, {" + ".join(f"hit_{c}" for c in _hits)} + has_contact::INT + has_url::INT AS n_markers,
         CASE WHEN visible = 0 THEN 1.0 ELSE round(least(1.0::DOUBLE, greatest(broken::DOUBLE / visible, 1 - canonical_length::DOUBLE / visible,
           CASE WHEN top::DOUBLE / visible >= 0.8 AND visible >= 8 THEN top::DOUBLE / visible ELSE 0 END, CASE WHEN visible <= 4 AND canonical_length = 0 THEN 1.0 ELSE 0 END)), 4) END AS noise_score
  FROM hit
), risked AS (
  SELECT *, round(least(1.0::DOUBLE, least(0.78::DOUBLE, n_categories * 0.22::DOUBLE) + least(0.24::DOUBLE, n_markers * 0.04::DOUBLE) + has_contact::INT * 0.12::DOUBLE + has_url::INT * 0.10::DOUBLE
         + CASE WHEN n_categories > 0 AND has_contact AND has_url THEN 0.12::DOUBLE ELSE 0::DOUBLE END), 4) AS risk_score
  FROM counted
), scored AS (
  SELECT *, CASE WHEN risk_score >= 0.82 THEN 'CRITICAL' WHEN risk_score >= 0.62 THEN 'HIGH' WHEN risk_score >= 0.35 THEN 'MEDIUM' WHEN risk_score > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level,
         'dedup:' || sha1(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]', '', 'g'))[1:16] AS dedup_group,
         round(greatest(least(0.20::DOUBLE + 0.28::DOUBLE * least(canonical_length / 80.0::DOUBLE, 1.0) + 0.22::DOUBLE * least(text_entropy / 3.5::DOUBLE, 1.0) + 0.30::DOUBLE * risk_score - 0.45::DOUBLE * noise_score, 1.0), 0.0), 4) AS quality_score
  FROM risked
), cleaned AS (
  SELECT *, CASE WHEN t = '' THEN 'empty_text' WHEN canonical_length = 0 THEN 'blank_or_garbled' WHEN noise_score >= 0.72 AND canonical_length < 12 AND risk_score < 0.25 THEN 'blank_or_garbled'
         WHEN text_entropy < 1.0 AND length(t) >= 8 AND risk_score < 0.35 THEN 'low_information_entropy' WHEN noise_score > 0.82 AND risk_score < 0.35 THEN 'high_noise_score'
         WHEN {_any(FIXTURE.defensive)} AND risk_score < 0.95 THEN 'defensive_context_noise' WHEN {_any(FIXTURE.guide)} AND risk_score < 0.80 THEN 'generic_guide_noise'
         WHEN canonical_length < 4 AND risk_score < 0.25 THEN 'low_signal_short_text' END AS drop_reason
  FROM scored
)"""
_defensive = f"({_any(FIXTURE.defensive)} AND NOT (has_contact AND {_any(FIXTURE.solicitation)}))"
_best = "list_max([" + ", ".join(f"{{'n': hit_{c}, 'c': '{c}'}}" for c in sorted(_hits)) + "])"
CLASSIFIED = f"""{CLEANED}, picked AS (
  SELECT *, CASE WHEN t = '' THEN 'unknown' WHEN {_defensive} THEN 'normal_noise' WHEN {_best}.n = 0 THEN 'unknown' ELSE {_best}.c END AS risk_category,
         CASE WHEN {_defensive} OR t = '' THEN 0 ELSE {_best}.n END AS hit_count FROM cleaned
), confident AS (
  SELECT *, CASE WHEN t = '' THEN 0.0::DOUBLE WHEN risk_category = 'normal_noise' THEN 0.82::DOUBLE WHEN risk_category = 'unknown' THEN 0.35::DOUBLE ELSE round(least(0.98::DOUBLE, 0.62::DOUBLE + hit_count * 0.08::DOUBLE), 4) END AS confidence FROM picked
), classified AS (
  SELECT *, CASE WHEN risk_category = 'normal_noise' THEN false ELSE confidence < 0.76 OR risk_category = 'unknown' END AS review_required,
         list_sort([{", ".join(f"hit_{c}" for c in _hits)}])[-2] AS runner_up FROM confident
), bucketed AS (
  SELECT *, CASE WHEN NOT review_required THEN 'auto' WHEN risk_category = 'unknown' OR confidence < 0.5 THEN 'manual' ELSE 'sample' END AS review_bucket,
         CASE WHEN hit_count - runner_up <= 1 AND runner_up >= 2 AND confidence >= 0.9 THEN 'resolved' WHEN hit_count - runner_up <= 1 AND runner_up >= 2 THEN 'conflict' ELSE 'none' END AS conflict_status,
         CASE WHEN drop_reason IS NOT NULL THEN 'skip' WHEN confidence >= 0.8 THEN 'deterministic' WHEN confidence >= 0.5 OR risk_score >= 0.35 THEN 'model' ELSE 'skip' END AS route
  FROM classified
)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean(table(spark, sf_dir, "documents"), FIXTURE)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.conflict(R.classify_fast(cleaned(spark, sf_dir), FIXTURE), FIXTURE)
    return R.route(df)


def _text(name: str, column, sql: str) -> None:  # noqa: ANN001
    """A query of one text function over all documents."""

    @register(name, rf"WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'), '[\s\x{{A0}}\x{{85}}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, {sql} AS value FROM d")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(T.compatible(F.col("text"))).alias("t"))
        return docs.select("doc_id", column(F.col("t")).alias("value"))


_text("fn_normalize_text", lambda t: F.sha1(t), "sha1(t)")
_text("fn_canonicalize", lambda t: F.sha1(T.canonical(t)), r"sha1(regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g'))")
_text("fn_dedup_id", T.dedup_id, r"'dedup:' || sha1(regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g'))[1:16]")
_text("fn_excerpt", T.excerpt, "CASE WHEN length(t) <= 160 THEN t ELSE t[1:157] || '...' END")
_text("fn_excerpt_around", lambda t: T.excerpt_around(t, "password"), "CASE WHEN instr(t, 'password') > 0 THEN t[greatest(instr(t, 'password') - 60, 1):instr(t, 'password') + 67] END")
_text("fn_mask_pii", lambda t: F.sha1(T.mask_pii(t)), "sha1(" + "regexp_replace(" * len(T.PII) + "t" + "".join(f", '{p}', '{label}', 'g')" for label, p in T.SQL_PII) + ")")
_text("fn_hash_pii", T.hash_pii, "sha256('clueforge:' || t)")
_text("fn_tokens", lambda t: F.size(T.tokens(t)).cast("long"), "len(regexp_extract_all(lower(t), '[a-z0-9]+'))::BIGINT")
_text("fn_term_test", lambda t: T.contains_term(t, "password"), "regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])password(?:$|[^A-Za-z0-9_])')")
_text("fn_mask_entity", T.mask, "CASE WHEN length(t) > 6 THEN t[1:2] || '***' || t[-2:] ELSE '***' END")
_text("fn_token_estimate", lambda t: F.floor(F.length(t) / 4).cast("long"), "(length(t) // 4)::BIGINT")
_text("fn_credential_url", lambda t: t.rlike("https?://[^/\\s:@]+:[^/\\s@]+@"), r"regexp_matches(t, 'https?://[^/\s:@]+:[^/\s@]+@')")


@register("fn_char_ngrams", "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, " + r"(SELECT CASE WHEN c = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(c) - 1, 2)), lambda i: c[i:i + 2]))) END FROM (SELECT regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g') AS c))::BIGINT" + " AS value FROM d")
def fn_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size(T.char_ngrams(F.col("c"))).cast("long").alias("value"))


def _record(name: str, frame, select: str, sql: str | None = None, common: str = CLEANED, source: str = "cleaned") -> None:  # noqa: ANN001
    """A query that selects columns of a record-level frame; `select` is valid in both dialects."""

    @register(name, f"WITH {common} SELECT {sql or select} FROM {source}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir).selectExpr(*[x.strip() for x in select.split(";")] if ";" in select else [x.strip() for x in select.split(",")])


_record("fn_noise", cleaned, "trace_id, noise_score")
_record("fn_entropy", cleaned, "trace_id, text_entropy")
_record("fn_quality", cleaned, "trace_id, quality_score")
_record("fn_risk_profile", cleaned, "trace_id, n_categories, n_markers, has_contact, has_url, risk_score, risk_level")
_record("flt_noise_reason", cleaned, "trace_id, drop_reason")
_record("flt_entropy", cleaned, "trace_id; CASE WHEN text_entropy < 1.0 OR noise_score > 0.82 THEN 'DROP' ELSE 'KEEP' END AS decision", "trace_id, CASE WHEN text_entropy < 1.0 OR noise_score > 0.82 THEN 'DROP' ELSE 'KEEP' END AS decision")
_record("flt_garbled", cleaned, "trace_id; canonical_length = 0 OR noise_score >= 0.72 AS garbled", "trace_id, canonical_length = 0 OR noise_score >= 0.72 AS garbled")
_record("dom_dedup_exact", cleaned, "trace_id, dedup_group")
_record("dom_clean", cleaned, "trace_id, source_name, noise_score, text_entropy, quality_score, risk_score, risk_level, drop_reason, dedup_group")
_record("dom_classify_fast", classified, "trace_id, risk_category, hit_count, confidence, review_required", common=CLASSIFIED, source="bucketed")
_record("dom_category_scores", classified, "trace_id, hit_credential, hit_contact, hit_insult, hit_prose", common=CLASSIFIED, source="bucketed")
_record("dom_conflict", classified, "trace_id, runner_up, conflict_status", common=CLASSIFIED, source="bucketed")
_record("dom_review_bucket", classified, "trace_id, review_bucket", common=CLASSIFIED, source="bucketed")
_record("dom_route_record", classified, "trace_id, route", common=CLASSIFIED, source="bucketed")


def _counts(name: str, frame, keys: list[str], common: str, source: str, where: str = "true") -> None:  # noqa: ANN001
    @register(name, f"WITH {common} SELECT {', '.join(keys)}, count(*) AS n FROM {source} WHERE {where} GROUP BY {', '.join(keys)}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir).where(where).groupBy(*keys).agg(F.count("*").alias("n"))


_counts("agg_counter_drop_reason", cleaned, ["drop_reason"], CLEANED, "cleaned")
_counts("agg_counter_risk_level", cleaned, ["risk_level"], CLEANED, "cleaned")
_counts("agg_counter_category_source", classified, ["risk_category", "source_name"], CLASSIFIED, "bucketed")
_counts("agg_counter_conflict", classified, ["conflict_status"], CLASSIFIED, "bucketed")
_counts("flt_high_risk", cleaned, ["source_name", "risk_level"], CLEANED, "cleaned", "risk_level IN ('HIGH', 'CRITICAL') AND quality_score >= 0.5")
_counts("agg_telemetry", classified, ["route", "review_bucket"], CLASSIFIED, "bucketed")


@register("clean_summary", f"WITH {CLEANED}, firsts AS (SELECT dedup_group, min(trace_id) AS first FROM cleaned GROUP BY 1) SELECT source_name, count(*) AS n, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (first <> trace_id) AS duplicates, round(avg(quality_score), 4) AS avg_quality, round(avg(risk_score), 4) AS avg_risk FROM cleaned JOIN firsts USING (dedup_group) GROUP BY 1")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.duplicate_of(cleaned(spark, sf_dir))
    return df.groupBy("source_name").agg(F.count("*").alias("n"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"), F.round(F.avg("quality_score"), 4).alias("avg_quality"), F.round(F.avg("risk_score"), 4).alias("avg_risk"))


@register("agg_avg", f"WITH {CLEANED} SELECT round(avg(quality_score), 4) AS mean_quality, round(avg(risk_score), 4) AS mean_risk, count(*) AS n FROM cleaned")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).agg(F.round(F.avg("quality_score"), 4).alias("mean_quality"), F.round(F.avg("risk_score"), 4).alias("mean_risk"), F.count("*").alias("n"))


@register("win_first_in_group", f"WITH {CLEANED} SELECT trace_id, nullif(min(trace_id) OVER (PARTITION BY dedup_group), trace_id) AS duplicate_of FROM cleaned")
def win_first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_of(cleaned(spark, sf_dir)).select("trace_id", "duplicate_of")


@register("agg_multilabel", f"WITH {CLEANED}, labels AS (SELECT source_name, unnest([{', '.join(f"CASE WHEN hit_{c} > 0 THEN '{c}' END" for c in _hits)}]) AS category FROM cleaned) SELECT category, source_name, count(*) AS n FROM labels WHERE category IS NOT NULL GROUP BY CUBE (category, source_name)")
def agg_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("source_name", F.explode("categories").alias("category")).cube("category", "source_name").agg(F.count("*").alias("n"))


@register("dom_secondary", f"WITH {CLASSIFIED} SELECT trace_id, CASE risk_category {' '.join(f"WHEN '{c}' THEN (SELECT CASE WHEN x.n > 0 THEN x.label END FROM (SELECT list_max([{', '.join(f"{{'n': {' + '.join(f'{_contains(t)}::INT' for t in terms)}, 'label': '{label}'}}" for label, terms in labels.items())}]) AS x))" for c, labels in FIXTURE.secondary.items())} END AS secondary_label FROM bucketed")
def dom_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.secondary_label(classified(spark, sf_dir), FIXTURE).select("trace_id", "secondary_label")


@register("dom_resolve", f"""WITH {CLASSIFIED}, both_answers AS (
  SELECT trace_id, risk_category AS rule, confidence AS rc, CASE WHEN trace_id % 3 = 0 THEN NULL WHEN toxic = 1 THEN 'insult' ELSE 'prose' END AS model, 0.85::DOUBLE AS mc FROM bucketed JOIN labels ON doc_id = trace_id
), decided AS (
  SELECT *, CASE WHEN model IS NULL THEN 'rule_only' WHEN rule = model THEN 'agree' WHEN rule = 'unknown' THEN 'model_fills' WHEN rule = 'normal_noise' AND mc < 0.9 THEN 'rule_defensive' WHEN mc >= rc + 0.1 THEN 'model_override' ELSE 'rule_kept' END AS strategy FROM both_answers
) SELECT trace_id, CASE WHEN strategy IN ('model_fills', 'model_override') THEN model ELSE rule END AS final_category, strategy FROM decided""")
def dom_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("trace_id"), "toxic")
    df = classified(spark, sf_dir).join(labels, "trace_id")
    model = F.when(F.col("trace_id") % 3 == 0, None).when(F.col("toxic") == 1, "insult").otherwise("prose")
    final, strategy = R.resolve(F.col("risk_category"), F.col("confidence"), F.col("model"), F.lit(0.85))
    return df.withColumn("model", model).select("trace_id", final.alias("final_category"), strategy.alias("strategy"))


@register("agg_review_load", f"WITH {CLASSIFIED} SELECT review_bucket, risk_category, count(*) AS n, round(avg(review_required::INT) * 100, 4) AS per_hundred FROM bucketed GROUP BY GROUPING SETS ((review_bucket), (risk_category), ())")
def agg_review_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classified(spark, sf_dir)
    return df.groupingSets([["review_bucket"], ["risk_category"], []], "review_bucket", "risk_category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("review_required").cast("int")) * 100, 4).alias("per_hundred"))


@register("agg_fpr", f"WITH {CLASSIFIED} SELECT round(count(*) FILTER (hit_insult > 0)::DOUBLE / count(*), 4) AS fpr, count(*) AS negatives FROM bucketed JOIN labels ON doc_id = trace_id WHERE toxic = 0")
def agg_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "trace_id"), "trace_id").where("toxic = 0")
    return df.agg(F.round(F.count_if(F.col("hit_insult") > 0) / F.count("*"), 4).alias("fpr"), F.count("*").alias("negatives"))


@register("agg_pair_metrics", f"""WITH {CLASSIFIED}, c AS (SELECT count(*) FILTER (toxic = 1 AND hit_insult > 0) AS tp, count(*) FILTER (toxic = 0 AND hit_insult > 0) AS fp, count(*) FILTER (toxic = 1 AND hit_insult = 0) AS fn FROM bucketed JOIN labels ON doc_id = trace_id)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM c""")
def agg_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "trace_id"), "trace_id")
    hit, true = F.col("hit_insult") > 0, F.col("toxic") == 1
    c = df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


@register("agg_confusion", f"WITH {CLASSIFIED} SELECT CASE WHEN toxic IS NULL THEN '__no_gold__' WHEN toxic = 1 THEN 'toxic' ELSE '__negative__' END AS expected, count(*) FILTER (hit_insult > 0) AS insult, count(*) FILTER (hit_insult = 0) AS other FROM bucketed LEFT JOIN labels ON doc_id = trace_id GROUP BY 1")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "trace_id"), "trace_id", "left")
    df = df.select(F.when(F.col("toxic").isNull(), "__no_gold__").when(F.col("toxic") == 1, "toxic").otherwise("__negative__").alias("expected"), F.when(F.col("hit_insult") > 0, "insult").otherwise("other").alias("actual"))
    return df.groupBy("expected").pivot("actual", ["insult", "other"]).count().na.fill(0)
