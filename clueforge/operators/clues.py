"""Clue-level decisions: corroboration, superseding, representatives, refinement, and review-only suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.operators.ordering import next_answers, numbered
from clueforge.session import materialise


def corroborated(left: DataFrame, right: DataFrame, hours: int = 48) -> DataFrame:
    """For each left row (id, source, ts) the right row (id, source, ts) that corroborates it: a_id, b_id, minutes.

    Rows go round in the order of time and id: the first right row of another
    source after the left one within `hours`, else the earliest one within `hours`
    before it. Rows without a time or source take no part; ids of each side are
    distinct. Each left row asks twice, from its own time and from `hours` before
    it, and the next right row answers; questions and answers are sorted in ranges
    of like size, so no pairs are made and no stretch of time is one task. Where
    both sides have a `place`, a_place and b_place are returned too.
    """
    size = hours * 3600
    more = ["place"] if "place" in left.columns and "place" in right.columns else []
    timed = lambda df: df.where("id is not null and source is not null and ts is not null").select("id", "source", F.unix_seconds("ts").alias("s"), *more)
    answers = timed(right).select("s", "id", "source", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("own"), *more, F.struct("s", "id", "source", *more).alias("answer"))
    none = F.lit(None).cast(answers.schema["answer"].dataType).alias("answer")
    asks = timed(left)
    ahead = asks.select("s", "id", "source", F.lit(0).alias("kind"), F.col("s").alias("own"), *more, none)
    behind = asks.select((F.col("s") - size).alias("s"), "id", "source", F.lit(2).alias("kind"), F.col("s").alias("own"), *more, none)
    # At one instant, a question from behind comes before all answers; one ahead comes after answers of lower and its own id.
    order = ["s", F.when(F.col("kind") == 2, 0).otherwise(1), "id", F.when(F.col("kind") == 1, 0).otherwise(1)]
    asked = next_answers(answers.unionByName(ahead).unionByName(behind), order)
    asked = asked.where((F.abs(F.col("found.s") - F.col("own")) <= size) & (F.col("found.id") != F.col("id")))
    best = asked.groupBy(F.col("id").alias("a_id")).agg(F.min(F.struct("kind", "found", "own", *more)).alias("m"))
    places = [F.col("m.place").alias("a_place"), F.col("m.found.place").alias("b_place")] if more else []
    return best.select("a_id", F.col("m.found.id").alias("b_id"), F.floor(F.abs(F.col("m.found.s") - F.col("m.own")) / 60).alias("minutes"), *places)


def order_distances(rows: DataFrame, hours: int = 48) -> DataFrame:
    """id, other, distance, minutes: for each row (id, source, ts) the nearest one in the circular order of time and id.

    The distance counts rows from a row forward to the other, past the end of the
    order to its beginning. Only rows of another source within `hours` count; a
    row without any is left out.
    """
    placed, n = numbered(rows.where("ts is not null"), [F.unix_seconds("ts"), "id"])
    placed = materialise(placed, "placed")
    pairs = corroborated(placed, placed, hours)
    round_ = F.pmod(F.col("b_place") - F.col("a_place"), F.lit(max(n, 1)))
    return pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), F.when(round_ == 0, F.lit(n)).otherwise(round_).alias("distance"), "minutes")


def chain_of(trace: Column) -> Column:
    """An aggregate: the identity of a set of distinct records, whatever their order, without holding them."""
    other = F.pmod(F.xxhash64(trace, F.lit(1)), F.lit(1 << 40))
    return F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64(trace)).cast("string"), F.sum(other).cast("string"))


#: The clue type of each entity type, and the types that count as accounts and as tools.
KINDS = {"email": "shared_contact_48h", "phone": "shared_contact_48h", "domain": "shared_domain_multi_source", "ip": "shared_tool_multi_source", "access_key": "shared_tool_multi_source"}
ACCOUNTS, TOOLS = ("email", "phone"), ("ip", "access_key")


def clue_objects(entities: DataFrame, templates: DataFrame, classes: DataFrame) -> DataFrame:
    """All clues that the engine finds: clue_id, clue_type, key, n_traces, n_sources, chain, entities, risk_category, confidence, weak_reason.

    entities: trace_id, source_name, entity_type, normalized; templates: trace_id,
    source_name, key; classes: trace_id, risk_category. A clue of an entity type is
    weak if one record has it. A tool in records with an account, and an account in
    records with a tool, are clues of the graph. Templates have three records, or
    two of two sources. The risk is that of most records, ties by the earliest one.
    Records are counted and hashed, never collected.
    """
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("entity_type")]
    own = entities.select(kind.alias("clue_type"), F.col("normalized").alias("key"), "trace_id", "source_name", "entity_type").where("clue_type is not null")
    has = own.groupBy("trace_id").agg(F.bool_or(F.col("entity_type").isin(*ACCOUNTS)).alias("account"), F.bool_or(F.col("entity_type").isin(*TOOLS)).alias("tool")).where("account and tool").select("trace_id")
    linked = own.join(has, "trace_id", "left_semi").where(F.col("entity_type").isin(*ACCOUNTS, *TOOLS)).withColumn("clue_type", F.when(F.col("entity_type").isin(*TOOLS), SPECIFIC[0]).otherwise(SPECIFIC[1]))
    cut = templates.select(F.explode(F.array(F.lit("shared_template_multi_source"), F.lit("high_frequency_template"))).alias("clue_type"), "key", "trace_id", "source_name")
    rows = own.unionByName(linked).drop("entity_type").unionByName(cut).distinct().join(classes.select("trace_id", "risk_category"), "trace_id")
    per = rows.groupBy("clue_type", "key", "risk_category").agg(F.count("*").alias("n"), F.min("trace_id").alias("first"))
    top = per.groupBy("clue_type", "key").agg(F.max_by("risk_category", F.struct("n", -F.col("first"))).alias("risk_category"))
    sized = rows.groupBy("clue_type", "key").agg(F.count("*").alias("n_traces"), F.countDistinct("source_name").alias("n_sources"), chain_of(F.col("trace_id")).alias("chain"))
    enough = F.when(F.col("clue_type") == "high_frequency_template", F.col("n_traces") >= 3).when(F.col("clue_type") == "shared_template_multi_source", (F.col("n_traces") >= 2) & (F.col("n_sources") >= 2)).otherwise(True)
    return sized.where(enough).join(top, ["clue_type", "key"]).withColumns({
        "clue_id": F.concat(F.lit("clue:"), F.substring(F.sha2(F.concat_ws(":", "clue_type", "key"), 256), 1, 16)),
        "entities": F.array("key"),
        "confidence": F.round(F.least(F.lit(0.98), 0.62 + F.col("n_traces") * 0.08 + F.col("n_sources") * 0.04), 4),
        "weak_reason": F.when(F.col("clue_type").isin(*KINDS.values()) & (F.col("n_traces") == 1), BRIDGE),
    })


SPECIFIC = ("entity_graph_account_tool_overlap", "entity_graph_tool_trade_cluster")
GENERIC = ("shared_contact_48h", "shared_tool_multi_source")
BRIDGE = "single_identifier_with_authorized_cross_source_corroboration"


def superseded(clues: DataFrame) -> DataFrame:
    """Adds archive_reason to clues (clue_type, key, chain, weak_reason) that a more specific clue of the same records covers, else null.

    What covers is found by joins on the key and the identity of the set of records.
    """
    df = clues.withColumns({"_key": F.lower(F.trim("key")), "_chain": F.col("chain"), "_kind": F.lower(F.trim("clue_type"))})
    named = lambda name, rows, on: rows.select(*on).distinct().withColumn(name, F.lit(True))
    df = df.join(named("_domain", df.where("_kind = 'shared_domain_multi_source'"), ["_chain"]), "_chain", "left")
    df = df.join(named("_cluster", df.where(F.col("_kind") == SPECIFIC[1]), ["_key", "_chain"]), ["_key", "_chain"], "left")
    df = df.join(named("_specific", df.where(F.col("_kind").isin(*SPECIFIC)), ["_key", "_chain"]), ["_key", "_chain"], "left")
    bridge = (F.col("_kind") == GENERIC[0]) & (F.coalesce("weak_reason", F.lit("")) == BRIDGE)
    direct = F.col("_key").rlike("^(telegram:|wechat:|qq:|tg:|wx:|@)")
    reason = (
        F.when(bridge & F.col("_domain"), "superseded_by_same_chain_domain_clue")
        .when(bridge & F.col("_cluster"), "superseded_by_same_chain_tool_cluster")
        .when(F.col("_kind").isin(*GENERIC) & ~direct & F.col("_specific"), "superseded_by_more_specific_graph_clue")
    )
    return df.withColumn("archive_reason", reason).drop("_key", "_chain", "_kind", "_domain", "_cluster", "_specific")


def bulk_represented(clues: DataFrame, bulk: int = 8) -> DataFrame:
    """Adds archive_reason where a template of `bulk` records or more makes one clue of a type stand for the others of its risk category.

    clues: clue_id, clue_type, n_traces, n_sources, risk_category, confidence, entities.
    """
    df = clues.withColumns({"_kind": F.lower("clue_type"), "_n": F.col("n_traces")})
    is_bulk = F.col("_kind").contains("template") & (F.col("_n") >= bulk)
    risks = df.where(is_bulk).select(F.lower("risk_category").alias("_risk")).distinct().withColumn("_bulk", F.lit(True))
    df = df.withColumn("_risk", F.lower("risk_category")).join(F.broadcast(risks), "_risk", "left")
    stands = F.col("_kind").isin("shared_contact_48h", "shared_domain_multi_source") & F.coalesce("_bulk", F.lit(False))
    rank = F.struct("confidence", "_n", "n_sources", "clue_id")
    best = df.where(stands).groupBy("_kind").agg(F.max(rank).alias("_best"))
    df = df.withColumn("_rank", rank).join(best, "_kind", "left")
    any_bulk = F.broadcast(risks.limit(1).select(F.lit(True).alias("_any")))
    df = df.join(any_bulk, F.lit(True), "left")
    bare = F.col("_kind").contains("template") & (F.size(F.filter(F.col("entities"), lambda e: e.rlike("[.:@]|^https?://"))) == 0)
    reason = F.when(stands & (F.col("_rank") != F.col("_best")), F.concat(F.lit("bulk_template_"), "_kind", F.lit("_represented_by_top_evidence"))).when(F.coalesce("_any", F.lit(False)) & bare & ~stands, "template_pattern_kept_in_candidate_pool_requires_key_entity_support")
    return df.withColumn("archive_reason", reason).drop("_kind", "_n", "_risk", "_bulk", "_best", "_rank", "_any")


def bridged(entities: DataFrame, pairs: DataFrame, kind: str, need: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Clues from entities of one record and the record that corroborates it: clue_type, key, trace, other.

    Only entities seen in a single record count; the record needs an entity of each group of types in `need`, and the first group's entities are the keys.
    """
    lone = entities.groupBy("entity_type", "normalized").agg(F.min("trace_id").alias("trace_id"), F.countDistinct("trace_id").alias("n")).where("n = 1").drop("n")
    types = lone.groupBy("trace_id").agg(F.collect_set("entity_type").alias("types"))
    for group in need:
        types = types.where(F.arrays_overlap("types", F.array(*map(F.lit, group))))
    keyed = lone.where(F.col("entity_type").isin(*need[0])).join(types.select("trace_id"), "trace_id", "left_semi")
    return keyed.join(pairs.select(F.col("a_id").alias("trace_id"), F.col("b_id").alias("other")), "trace_id").select(F.lit(kind).alias("clue_type"), F.col("normalized").alias("key"), "trace_id", "other")


def refine_target(quality: Column, confidence: Column, traces: Column, sources: Column, entities: Column, review: Column, summary: Column, refined: Column, weak_graph: Column, least: float = 0.65) -> tuple[Column, Column]:
    """(whether a clue deserves refinement, why), by the first rule that fits."""
    has_summary = F.length(F.trim(F.coalesce(summary, F.lit("")))) > 0
    no = (
        F.when(weak_graph, "weak_graph_clue_without_sensitive_entity")
        .when(refined & (quality >= max(least, 0.82)) & (traces >= 2), "already_refined_complete_high_quality")
        .when((quality >= least) & (traces >= 2) & (sources >= 2) & ~review & has_summary, "actionable_complete_without_refine_need")
    )
    yes = F.when(review, "conflict_review").when((quality >= least) & (~has_summary | (confidence < 0.78)), "actionable_missing_summary_or_confidence").when((quality >= least - 0.12) & (quality < least) & ((entities > 0) | (traces > 0)), "near_threshold_high_risk")
    return no.isNull() & yes.isNotNull(), F.coalesce(no, yes, F.lit("outside_refine_target_policy"))


def enrich_policy(profile: Column, has_metrics: Column, explicit: Column, enabled: Column, gains: list[Column], tokens: Column, least_gain: float = 0.01, most_tokens: float = 10_000.0) -> Column:
    """Whether records are worth a model call, from what earlier runs gained."""
    gain = F.greatest(*[F.coalesce(g, F.lit(0.0)) for g in gains])
    return (
        F.when(F.lower(F.trim(F.coalesce(profile, F.lit("")))) == "fast", "disabled")
        .when(~has_metrics, "hard_cases_only")
        .when(F.lower(F.trim(explicit)).isin("enabled", "hard_cases_only", "conflict_only", "disabled"), F.lower(F.trim(explicit)))
        .when(F.coalesce(~enabled, F.lit(False)), "conflict_only")
        .when((gain < least_gain) & (tokens.isNull() | (tokens > most_tokens)), "conflict_only")
        .otherwise("enabled")
    )


#: Words of actions, by what they would break.
BREACHES = (
    ("formal_write", ("write entity", "write strategy", "write label", "write wordlist")),
    ("online_enforcement", ("ban", "block", "blacklist", "intercept")),
    ("unauthorized_collection", ("bypass", "crack", "unauthorized", "scrape private")),
)
LOCAL_TARGETS, OUTBOUND, PERSONAL = ("review_repo", "review_queue", "human_review"), ("send", "upload", "post to", "export"), ("phone", "email", "account", "contact")


def safety_breach(action: Column, target: Column, breaches: tuple = BREACHES, local_targets: tuple[str, ...] = LOCAL_TARGETS, outbound: tuple[str, ...] = OUTBOUND, personal: tuple[str, ...] = PERSONAL) -> Column:
    """The rule that a proposed action breaks, or null; only writes to local review targets may carry personal data.

    The first two of `breaches` come before personal data, the others after it.
    """
    low, place = F.lower(F.coalesce(action, F.lit(""))), F.lower(F.coalesce(target, F.lit("")))
    hit = lambda col, words: col.rlike("|".join(rf"\b{w}\b" for w in words))
    local = hit(place, local_targets) | hit(low, local_targets)
    found = F.lit(None).cast("string")
    for name, words in reversed(breaches[2:]):
        found = F.when(hit(low, words), name).otherwise(found)
    found = F.when(~local & hit(low, outbound) & hit(low, personal), "pii_exfiltration").otherwise(found)
    for name, words in reversed(breaches[:2]):
        found = F.when(hit(low, words), name).otherwise(found)
    return found


def suggestions(clues: DataFrame) -> DataFrame:
    """A review-only suggestion for each clue: what to watch and what is never done by itself."""
    return clues.select(
        F.concat(F.lit("strategy:"), F.substring(F.sha2(F.concat_ws(":", "clue_id", F.lit("strategy")), 256), 1, 12)).alias("strategy_id"),
        F.col("clue_id").alias("target_id"),
        F.concat(F.lit("review "), "clue_type", F.lit("="), "key").alias("recommendation"),
        F.lit("review_only_dashboard_then_low_impact_monitoring").alias("scope"),
        F.lit("auto_ban,auto_block,auto_blacklist,production_strategy_write").alias("forbidden"),
        F.round("confidence", 4).alias("confidence"),
    )
