"""Entities, their observation graph, cross-source clues, promotion and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.functions import text as T
from clueforge.rules import RulePack
from clueforge.session import materialise

#: Entity types and their patterns, in the order of priority.
PATTERNS = {
    "email": T.EMAIL,
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9][ ().0-9-]{7,18}[0-9]",
    "access_key": r"AKIA[A-Z0-9]{12,20}",
    "domain": r"(?:\G|(?<![a-z0-9-]))[a-z0-9-]++\.example\.com",
}
#: The same for engines that are linear by themselves.
SQL_PATTERNS = PATTERNS | {"email": T.EMAIL_SQL, "domain": r"[a-z0-9-]+\.example\.com"}


def normalize_entity(kind: Column, value: Column) -> Column:
    """The canonical form of a value of a type."""
    return F.when(kind == "phone", F.concat(F.lit("+"), F.regexp_replace(value, "[^0-9]", ""))).when(kind == "access_key", F.upper(value)).otherwise(F.lower(value))


#: What a text must hold for a pattern to be worth a try: a literal, or a shorter pattern.
GUARDS = {"email": "@", "phone": "+", "access_key": "AKIA", "domain": ".example.com"}
IP_GUARD = r"[0-9]\.[0-9]"


def extract(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record and distinct entity: trace_id, source_name, entity_type, entity_value, normalized, n, masked, canonical_hash, entity_id, and the columns to `keep`.

    A pattern is tried only on texts that hold what it needs, and the text is
    normalised once: nothing of it is asked for before it is computed.
    """
    none = F.array().cast("array<struct<entity_type: string, entity_value: string>>")

    def typed(kind: str, pattern: str) -> Column:
        worth = F.contains("clean_text", F.lit(GUARDS[kind])) if kind in GUARDS else F.col("clean_text").rlike(IP_GUARD)
        values = F.regexp_extract_all("clean_text", F.lit(pattern), F.lit(0))
        return F.when(worth, F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value")))).otherwise(none)

    found = records.select("trace_id", "source_name", *keep, F.explode(F.flatten(F.array(*[typed(k, p) for k, p in PATTERNS.items()]))).alias("e"))
    rows = found.select("trace_id", "source_name", *keep, "e.*").withColumn("normalized", normalize_entity(F.col("entity_type"), F.col("entity_value")))
    rows = rows.groupBy("trace_id", "source_name", "entity_type", "normalized").agg(F.min("entity_value").alias("entity_value"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in keep])
    return rows.withColumns({"masked": T.mask(F.col("normalized")), "canonical_hash": T.hash_pii(F.col("normalized")), "entity_id": entity_id(F.col("entity_type"), F.col("normalized"))})


def entity_id(kind: Column, normalized: Column) -> Column:
    return F.concat(F.lit("entity:"), kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", kind, normalized), 256), 1, 16))


def observation_id(entity: Column, trace: Column) -> Column:
    return F.concat(entity, F.lit(":"), F.substring(F.sha2(trace.cast("string"), 256), 1, 12))


def assets(entities: DataFrame) -> DataFrame:
    """One row per entity: type, mask, aliases, first and last trace, records and sources."""
    return entities.groupBy("entity_id", "entity_type", "masked").agg(F.countDistinct("entity_value").alias("n_aliases"), F.min("trace_id").alias("first_trace"), F.max("trace_id").alias("last_trace"), F.countDistinct("trace_id").alias("n_traces"), F.countDistinct("source_name").alias("n_sources"))


def cooccurrence(entities: DataFrame, block: int = 64) -> DataFrame:
    """Relations between entities of one record: (src, dst, n_traces, confidence), src < dst.

    All pairs of a record's distinct entities count. Its sorted entities are cut
    in blocks, and each pair of blocks is a row of its own that is dealt out by
    its key, so no row holds more than the pairs of two blocks and a record with
    very many entities spreads over the tasks.
    """
    per = entities.groupBy("trace_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).where(F.size("ids") > 1)
    last = F.floor((F.size("ids") - 1) / block).cast("int")
    cut = lambda i: F.slice("ids", i * block + 1, block)
    firsts = per.select("trace_id", "ids", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    blocks = firsts.select("trace_id", "i", cut(F.col("i")).alias("left"), F.posexplode(F.transform(F.sequence(F.col("i"), last), cut)).alias("j", "right"))
    pairs = F.flatten(F.transform("left", lambda a: F.transform(F.filter("right", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    rows = blocks.repartition("trace_id", "i", "j").select("trace_id", F.explode(pairs).alias("p"))
    return rows.groupBy("p.src", "p.dst").agg(F.countDistinct("trace_id").alias("n_traces"), F.lit(0.72).alias("confidence"))


def risk_profiles(entities: DataFrame, relations: DataFrame, categories: DataFrame) -> DataFrame:
    """Per entity: observations, sources, neighbours, categories and a score. categories: trace_id, risk_category."""
    seen = entities.join(categories, "trace_id", "left").groupBy("entity_id").agg(
        F.countDistinct("trace_id").alias("observations"), F.countDistinct("source_name").alias("sources"), F.countDistinct(F.when(~F.col("risk_category").isin("unknown", "normal_noise"), F.col("risk_category"))).alias("n_categories")
    )
    ends = relations.select(F.col("src").alias("entity_id")).union(relations.select(F.col("dst").alias("entity_id")))
    near = ends.groupBy("entity_id").agg(F.count("*").alias("neighbours"))
    df = seen.join(near, "entity_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    score = 28 + 5 * F.least("observations", F.lit(10)) + 6 * F.least("sources", F.lit(5)) + 4 * F.least("neighbours", F.lit(8)) + 16 * (F.col("n_categories") > 0).cast("int")
    return df.withColumn("risk_score", F.least(score, F.lit(99)).cast("long"))


def neighborhood(relations: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(entity_id, hops): what is reached from `start` (entity_id) in at most `depth` hops, each with the least hops."""
    both = relations.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(relations.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    reached = start.select("entity_id").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        edge = reached.where(F.col("hops") == hop - 1).join(both, F.col("entity_id") == F.col("a")).select(F.col("b").alias("entity_id"), F.lit(hop).alias("hops"))
        reached = reached.union(edge).groupBy("entity_id").agg(F.min("hops").alias("hops"))
    return reached


def shared_clues(entities: DataFrame, classes: DataFrame | None = None, min_traces: int = 2, min_sources: int = 2) -> DataFrame:
    """A clue for each entity with enough records and sources.

    classes: trace_id, risk_category, confidence; without it the entities have these
    columns. The dominant category has most records, ties by the earliest record
    that has it. The entities are read once: their sums by category and source,
    which are few, are stored, and both the size and the category come from them.
    """
    rows = entities if classes is None else entities.join(classes, "trace_id")
    sums = rows.groupBy("entity_type", "normalized", "risk_category", "source_name").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.min("trace_id").alias("first"), F.max("trace_id").alias("last"))
    sums = materialise(sums, "entity-sums")
    per = sums.groupBy("entity_type", "normalized", "risk_category").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    top = per.groupBy("entity_type", "normalized").agg(F.max_by("risk_category", F.struct("n", -F.col("first"))).alias("risk_category"))
    sized = sums.groupBy("entity_type", "normalized").agg(
        F.sum("n").alias("n_traces"), F.countDistinct("source_name").alias("n_sources"), F.round(F.sum("c") / F.sum("n"), 4).alias("avg_confidence"), F.min("first").alias("first_trace"), F.max("last").alias("last_trace")
    )
    kept = sized.where((F.col("n_traces") >= min_traces) & (F.col("n_sources") >= min_sources)).join(top, ["entity_type", "normalized"])
    return kept.withColumns({"clue_type": F.concat(F.lit("shared_"), "entity_type"), "key": F.col("normalized"), "clue_id": clue_id(F.concat(F.lit("shared_"), "entity_type"), F.col("normalized")), "confidence": F.round(F.least(F.lit(0.98), 0.62 + F.col("n_traces") * 0.08 + F.col("n_sources") * 0.04), 4)}).drop("normalized")


def clue_id(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("clue:"), F.substring(F.sha2(F.concat_ws(":", kind, key), 256), 1, 16))


def template_clues(records: DataFrame, size: int = 80, min_shared: int = 2, min_frequent: int = 3) -> DataFrame:
    """Texts that begin alike: shared_template (two records and sources) and high_frequency_template (three records)."""
    text = T.mask_pii(F.col("clean_text"))
    rows = records.select("trace_id", "source_name", F.substring(T.canonical(text), 1, size).alias("key")).where(F.length("key") >= 12)
    per = rows.groupBy("key").agg(F.countDistinct("trace_id").alias("n_traces"), F.countDistinct("source_name").alias("n_sources"))
    shared = per.where((F.col("n_traces") >= min_shared) & (F.col("n_sources") >= 2)).withColumn("clue_type", F.lit("shared_template"))
    frequent = per.where(F.col("n_traces") >= min_frequent).withColumn("clue_type", F.lit("high_frequency_template"))
    return shared.unionByName(frequent).withColumn("confidence", F.round(F.least(F.lit(0.98), 0.62 + F.col("n_traces") * 0.08 + F.col("n_sources") * 0.04), 4))


def promote(clues: DataFrame, pack: RulePack) -> DataFrame:
    """Adds actionability, promoted and promotion_reason by the first rule of the pack that fits the clue's entity type."""
    score = F.round(F.least(F.lit(0.99), 0.2 + F.least("n_traces", F.lit(4)) * 0.12 + F.least("n_sources", F.lit(3)) * 0.12 + 0.06 + F.when(F.col("entity_type").isin("email", "phone", "domain"), 0.18).otherwise(0.0)), 4)
    passed, reason = F.lit(False), F.lit("no_promotion_rule_matched")
    for rule in reversed(pack.promotion):
        fits = F.col("entity_type").isin(*rule["types"])
        enough = (F.col("n_sources") >= rule["min_sources"]) & (F.col("n_traces") >= rule["min_traces"])
        passed = F.when(fits, enough).otherwise(passed)
        reason = F.when(fits, F.when(enough, rule["pass"]).otherwise(rule["fail"])).otherwise(reason)
    return clues.withColumns({"actionability": score, "promoted": passed, "promotion_reason": reason})


def quality(clues: DataFrame, fresh: Column, profile: str = "balanced", critical: tuple[str, ...] = ("email", "phone", "domain", "access_key")) -> DataFrame:
    """Adds false_positive_risk, clue_quality, quality_level and passed."""
    threshold = {"high_precision": 0.78, "high_recall": 0.52}.get(profile, 0.65)
    is_critical = F.col("entity_type").isin(*critical)
    risk = 0.1 + F.when(F.col("n_sources") < 2, 0.25).otherwise(0.0) + F.when(F.col("n_traces") < 2, 0.2).otherwise(0.0) + F.when(~is_critical, 0.1).otherwise(0.0) + F.when(F.col("avg_confidence") < 0.55, 0.2).otherwise(0.0) + F.when(fresh <= 0.25, 0.1).otherwise(0.0)
    df = clues.withColumn("false_positive_risk", F.round(F.least(risk, F.lit(0.99)), 4))
    score = F.col("confidence") * 0.45 + F.least("n_traces", F.lit(4)) / 4.0 * 0.2 + F.least("n_sources", F.lit(3)) / 3.0 * 0.2 + F.col("avg_confidence") * 0.15 + fresh * 0.08 - F.col("false_positive_risk") * 0.12
    df = df.withColumn("clue_quality", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(0.99))), 4))
    return df.withColumns({"quality_level": F.when(F.col("clue_quality") >= max(threshold, 0.82), "high").when(F.col("clue_quality") >= threshold, "medium").otherwise("low"), "passed": F.col("clue_quality") >= threshold})


def best_of_identity(clues: DataFrame) -> DataFrame:
    """The best clue of each (clue_type, risk_category): quality, records, sources, then key."""
    order = Window.partitionBy("clue_type", "risk_category").orderBy(F.desc("clue_quality"), F.desc("n_traces"), F.desc("n_sources"), "key")
    return clues.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def evidence(clues: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each clue and record: clue_id, trace_id, source_name, excerpt."""
    keyed = entities.select(clue_id(F.concat(F.lit("shared_"), "entity_type"), F.col("normalized")).alias("clue_id"), "trace_id").distinct()
    return clues.select("clue_id").join(keyed, "clue_id").join(records.select("trace_id", "source_name", T.excerpt(F.col("clean_text")).alias("excerpt")), "trace_id")
