"""Record operators: cleaning, risk, drop reasons, duplicates, classification and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.functions import text as T
from clueforge.rules import RulePack
from clueforge.session import spread

CONTACT = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]|\+[0-9][ ().0-9-]{7,}"
URL = r"https?://"


def records(docs: DataFrame) -> DataFrame:
    """trace_id, source_name, clean_text of a table of documents."""
    return spread(docs).select(F.col("doc_id").alias("trace_id"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("source_name"), T.normalize_text(T.compatible(F.col("text"))).alias("clean_text"))


def score_risk(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds n_categories, categories, n_markers, has_contact, has_url, risk_score and risk_level."""
    hits = pack.hits(F.col("clean_text"))
    df = df.withColumns({f"hit_{c}": h for c, h in hits.items()} | {"has_contact": F.col("clean_text").rlike(CONTACT), "has_url": F.col("clean_text").rlike(URL)})
    contact, url = F.col("has_contact").cast("int"), F.col("has_url").cast("int")
    n_categories = sum(((F.col(f"hit_{c}") > 0).cast("int") for c in hits), F.lit(0))
    n_markers = sum((F.col(f"hit_{c}") for c in hits), F.lit(0)) + contact + url
    df = df.withColumns({"n_categories": n_categories, "n_markers": n_markers})
    score = (
        F.least(F.lit(0.78), F.col("n_categories") * 0.22)
        + F.least(F.lit(0.24), F.col("n_markers") * 0.04)
        + contact * 0.12
        + url * 0.10
        + F.when((F.col("n_categories") > 0) & F.col("has_contact") & F.col("has_url"), 0.12).otherwise(0.0)
    )
    df = df.withColumn("risk_score", F.round(F.least(score, F.lit(1.0)), 4))
    return df.withColumns(
        {
            "risk_level": F.when(F.col("risk_score") >= 0.82, "CRITICAL").when(F.col("risk_score") >= 0.62, "HIGH").when(F.col("risk_score") >= 0.35, "MEDIUM").when(F.col("risk_score") > 0, "LOW").otherwise("NONE"),
            "categories": F.array_compact(F.array(*[F.when(F.col(f"hit_{c}") > 0, F.lit(c)) for c in hits])),
        }
    )


def clean(docs: DataFrame, pack: RulePack, max_noise: float = 0.82, min_entropy: float = 1.0) -> DataFrame:
    """All record-level columns: statistics, risk, quality, drop_reason and dedup_group.

    Reasons are tried in a fixed order; duplicates are found on the full text.
    """
    df = score_risk(records(docs).withColumn("stats", T.char_stats("clean_text")), pack)
    df = df.withColumns({"noise_score": T.noise_score(F.col("stats")), "text_entropy": F.round("stats.entropy", 4), "canonical_length": F.col("stats.signal"), "dedup_group": T.dedup_id(F.col("clean_text"))})
    df = df.withColumn("quality_score", T.quality_score(F.col("canonical_length"), F.col("text_entropy"), F.col("risk_score"), F.col("noise_score")))
    risk, size = F.col("risk_score"), F.length("clean_text")
    reason = (
        F.when(size == 0, "empty_text")
        .when(F.col("canonical_length") == 0, "blank_or_garbled")
        .when((F.col("noise_score") >= 0.72) & (F.col("canonical_length") < 12) & (risk < 0.25), "blank_or_garbled")
        .when((F.col("text_entropy") < min_entropy) & (size >= 8) & (risk < 0.35), "low_information_entropy")
        .when((F.col("noise_score") > max_noise) & (risk < 0.35), "high_noise_score")
        .when(pack.any_of(F.col("clean_text"), pack.defensive) & (risk < 0.95), "defensive_context_noise")
        .when(pack.any_of(F.col("clean_text"), pack.guide) & (risk < 0.80), "generic_guide_noise")
        .when((F.col("canonical_length") < 4) & (risk < 0.25), "low_signal_short_text")
    )
    return df.withColumn("drop_reason", reason).drop("stats")


def duplicate_of(df: DataFrame, group: str = "dedup_group", order: str = "trace_id") -> DataFrame:
    """Adds duplicate_of, the first record of the group, or null for that one.

    The first is a partial aggregate joined back, so a group of any size spreads.
    """
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    return df.join(first, group).withColumn("duplicate_of", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_first")


def truncate(df: DataFrame, most: int = 4000) -> DataFrame:
    """The stored text; it is cut only after duplicates are known."""
    return df.withColumn("clean_text", F.substring("clean_text", 1, most))


def classify_fast(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds risk_category, hit_count, confidence, review_required and review_bucket."""
    order = sorted(pack.categories)
    best = F.array_max(F.array(*[F.struct(F.col(f"hit_{c}").alias("n"), F.lit(c).alias("c")) for c in order]))
    defensive = pack.any_of(F.col("clean_text"), pack.defensive) & ~(F.col("has_contact") & pack.any_of(F.col("clean_text"), pack.solicitation))
    df = df.withColumn("_best", best)
    df = df.withColumns(
        {
            "risk_category": F.when(F.length("clean_text") == 0, "unknown").when(defensive, "normal_noise").when(F.col("_best.n") == 0, "unknown").otherwise(F.col("_best.c")),
            "hit_count": F.when(defensive | (F.length("clean_text") == 0), 0).otherwise(F.col("_best.n")),
        }
    )
    df = df.withColumn("confidence", F.when(F.length("clean_text") == 0, 0.0).when(F.col("risk_category") == "normal_noise", 0.82).when(F.col("risk_category") == "unknown", 0.35).otherwise(F.round(F.least(F.lit(0.98), 0.62 + F.col("hit_count") * 0.08), 4)))
    df = df.withColumn("review_required", F.when(F.col("risk_category") == "normal_noise", False).otherwise((F.col("confidence") < 0.76) | (F.col("risk_category") == "unknown")))
    bucket = F.when(~F.col("review_required"), "auto").when((F.col("risk_category") == "unknown") | (F.col("confidence") < 0.5), "manual").otherwise("sample")
    return df.withColumn("review_bucket", bucket).drop("_best")


def secondary_label(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds the secondary label with most hits in the record's category; ties to the later name."""
    low = F.lower("clean_text")
    choices = []
    for category, labels in pack.secondary.items():
        for label, terms in labels.items():
            n = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
            choices.append(F.when(F.col("risk_category") == category, F.struct(n.alias("n"), F.lit(label).alias("label"))))
    best = F.array_max(F.array_compact(F.array(*choices)))
    return df.withColumn("secondary_label", F.when(best["n"] > 0, best["label"]))


def conflict(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds runner_up (hits of the second category) and conflict_status."""
    counts = F.array_sort(F.array(*[F.col(f"hit_{c}") for c in sorted(pack.categories)]))
    df = df.withColumn("runner_up", F.element_at(counts, -2))
    close = (F.col("hit_count") - F.col("runner_up") <= 1) & (F.col("runner_up") >= 2)
    return df.withColumn("conflict_status", F.when(close & (F.col("confidence") >= 0.9), "resolved").when(close, "conflict").otherwise("none"))


def polarity(df: DataFrame, pack: RulePack) -> DataFrame:
    """Adds polarity: defensive, negated, solicitation or neutral, in this order, unnegated solicitation with contact first."""
    low = F.lower("clean_text")
    asks = pack.any_of(low, pack.solicitation)
    denied = F.lit(True)
    for term in pack.solicitation:
        denied = denied & (~low.contains(term) | T.negated(low, term, tuple(rf"\b{n}\b" for n in pack.negation)))
    return df.withColumn("polarity", F.when(asks & ~denied & F.col("has_contact"), "solicitation").when(pack.any_of(low, pack.defensive), "defensive").when(asks & denied, "negated").when(asks, "solicitation").otherwise("neutral"))


def resolve(rule: Column, rule_confidence: Column, model: Column, model_confidence: Column) -> tuple[Column, Column]:
    """The final category and the strategy, from a rule's and a model's answer."""
    strategy = (
        F.when(model.isNull(), "rule_only")
        .when(rule == model, "agree")
        .when(rule == "unknown", "model_fills")
        .when((rule == "normal_noise") & (model_confidence < 0.9), "rule_defensive")
        .when(model_confidence >= rule_confidence + 0.1, "model_override")
        .otherwise("rule_kept")
    )
    return F.when(strategy.isin("model_fills", "model_override"), model).otherwise(rule), strategy


def route(df: DataFrame, low: float = 0.5, high: float = 0.8) -> DataFrame:
    """Adds route: skip, deterministic or model."""
    return df.withColumn("route", F.when(F.col("drop_reason").isNotNull(), "skip").when(F.col("confidence") >= high, "deterministic").when((F.col("confidence") >= low) | (F.col("risk_score") >= 0.35), "model").otherwise("skip"))


def within_budget(df: DataFrame, cost: Column, most: int, order: str) -> DataFrame:
    """Adds the running cost in order and whether it fits; for a plan of bounded size, not a corpus."""
    running = F.sum(cost).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", running).withColumn("granted", F.col("spent") <= most)
