"""Decisions as columns: source policy, relevance, routing of clues, gates, budgets and review order.

Decisions are for human review; nothing here acts on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.functions.terms import matcher

ALLOWED = ("public", "authorized", "partner", "synthetic")
FORBIDDEN = ("login", "private", "paywall", "captcha")


def source_decision(basis: Column, note: Column) -> Column:
    """accepted, or why a source is not."""
    low = F.lower(F.coalesce(note, F.lit("")))
    forbidden = F.lit(False)
    for term in FORBIDDEN:
        forbidden = forbidden | low.contains(term)
    return F.when(~F.coalesce(F.lower(basis).isin(*ALLOWED), F.lit(False)), "rejected_legal_basis").when(forbidden, "rejected_forbidden_marker").otherwise("accepted")


def guard(url: Column, basis: Column) -> Column:
    """ok, or the rule that a source address breaks."""
    return F.when(url.rlike(r"https?://[^/\s:@]+:[^/\s@]+@"), "credentials_in_url").when(basis.isNull(), "missing_legal_basis").otherwise("ok")


def compliance(basis: Column, rate_limited: Column, terms_known: Column) -> Column:
    return F.when(basis.isNull(), "REJECTED").when(~terms_known, "NEEDS_LEGAL_REVIEW").when(~rate_limited, "NEEDS_RATE_LIMIT").otherwise("SCHEDULABLE")


def relevance(records: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), themes: dict[str, tuple[str, ...]] | None = None, banned: tuple[str, ...] = (), weak: tuple[str, tuple[str, ...]] | None = None, least: int = 1, text: str = "text") -> DataFrame:
    """Adds matched, excluded, matched_themes, excluded_themes (arrays), hit_count and relevant.

    `themes` are named lists of terms; those named in `banned` exclude, the others
    include. `weak` names a theme and the terms of which one at least must occur
    beside it, else the theme and its terms don't count. An exclusion always wins.
    With terms or themes to include, `least` of them must occur; without any, every
    text that is not blank is relevant. All terms are looked up in one pass.
    """
    themes = {name: tuple(dict.fromkeys(t.strip().lower() for t in terms)) for name, terms in (themes or {}).items()}
    include, exclude = (tuple(dict.fromkeys(t.strip().lower() for t in x)) for x in (include, exclude))
    wanted = {n: t for n, t in themes.items() if n not in banned}
    support = tuple(t.strip().lower() for t in weak[1]) if weak else ()
    every = [*include, *exclude, *(t for terms in themes.values() for t in terms), *support]
    df = records.withColumn("_hits", matcher(records.sparkSession, every)(F.col(text)))
    hit = lambda terms: F.array_intersect("_hits", F.array(*map(F.lit, terms)).cast("array<string>"))
    named = lambda names: F.array_compact(F.array(*[F.when(F.size(hit(themes[n])) > 0, F.lit(n)) for n in names]).cast("array<string>"))
    counted = {n: F.lit(True) if not weak or n != weak[0] else F.size(hit(support)) > 0 for n in wanted}
    theme_terms = F.flatten(F.array(*[F.when(counted[n], hit(t)).otherwise(F.array().cast("array<string>")) for n, t in wanted.items()])) if wanted else F.array().cast("array<string>")
    matched_themes = named(wanted)
    if weak and weak[0] in wanted:
        matched_themes = F.when(counted[weak[0]], matched_themes).otherwise(F.array_remove(matched_themes, weak[0]))
    df = df.withColumns({"matched": F.array_distinct(F.concat(hit(include), theme_terms)), "excluded": F.array_distinct(F.concat(hit(exclude), *[hit(themes[n]) for n in themes if n in banned])), "matched_themes": matched_themes, "excluded_themes": named([n for n in themes if n in banned])})
    enough = F.size("matched") >= max(1, least) if include or wanted else F.coalesce(F.trim(text) != "", F.lit(False))
    return df.withColumns({"hit_count": F.size("matched"), "relevant": (F.size("excluded") == 0) & enough}).drop("_hits")


def playbooks(clues: DataFrame, evidence: DataFrame, texts: DataFrame, elements: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """risk_category, clue_count, evidence_count, elements (map of element to sorted terms), confidence.

    A category with two clues or more whose records' texts hold terms of `least`
    elements or more. clues: clue_id, risk_category; evidence: clue_id, trace_id;
    texts: trace_id, text. Terms are looked up in each text that is evidence, once,
    in one pass for all terms; a category's hits are then united, never its texts.
    """
    members = evidence.join(clues.select("clue_id", "risk_category"), "clue_id").select("risk_category", "trace_id").distinct()
    counts = clues.groupBy("risk_category").agg(F.countDistinct("clue_id").alias("clue_count")).where("clue_count >= 2")
    owner = {}
    for element, terms in elements.items():
        for term in terms:
            owner.setdefault(term.strip().lower(), []).append(element)
    seen = texts.join(members.select("trace_id").distinct(), "trace_id", "left_semi")
    hits = seen.select("trace_id", F.explode(matcher(texts.sparkSession, owner)(F.col("text"))).alias("term"))
    pairs = texts.sparkSession.createDataFrame([(t, e) for t, es in owner.items() for e in es], "term string, element string")
    found = members.join(hits, "trace_id").select("risk_category", "term").distinct().join(F.broadcast(pairs), "term")
    listed = found.groupBy("risk_category", "element").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    listed = listed.groupBy("risk_category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "terms")))).alias("elements"))
    sized = members.groupBy("risk_category").agg(F.count("*").alias("evidence_count"))
    kept = counts.join(listed, "risk_category").join(sized, "risk_category").where(F.size("elements") >= least)
    return kept.withColumn("confidence", F.round(F.least(F.lit(0.96), 0.58 + 0.07 * F.col("clue_count") + 0.04 * F.size("elements")), 4))


def canonical_themes(themes: Column, aliases: dict[str, str]) -> Column:
    """Themes by their canonical names, each once, unknown ones as they are."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(themes, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), F.lower(t)))))


def quota_groups(source: Column, lang: Column, size: Column) -> Column:
    """All groups that a record counts for."""
    return F.array_compact(F.array(F.concat(F.lit("lang:"), lang), F.when(size > 2000, F.lit("size:long")).otherwise(F.lit("size:short")), F.when(source.isin("src0", "src1"), F.lit("tier:core"))))


def enforcement_decision(score: Column, reviewed: Column, dry_run: Column) -> Column:
    """What a gate would say; no connector exists."""
    return F.when(score < 0.5, "BLOCKED").when(~reviewed, "REVIEW_REQUIRED").when(dry_run, "DRY_RUN").otherwise("READY_FOR_OPERATOR")


def refinement(score: Column, sources: Column) -> Column:
    return F.when(score >= 0.82, "skip_strong").when((score >= 0.5) & (sources >= 2), "refine").when(score >= 0.35, "collect_more").otherwise("archive")


def review_state(decision: Column) -> Column:
    """The state after a decision, whose aliases are folded."""
    d = F.lower(F.trim(decision))
    return F.when(d.isin("ok", "accept", "accepted", "approve", "yes"), "ACCEPTED").when(d.isin("no", "reject", "rejected"), "REJECTED").when(d.isin("later", "defer", "hold"), "DEFERRED").otherwise("PENDING")


def lifecycle(events: DataFrame) -> DataFrame:
    """The stage of each term from its events (term, seq, event): the furthest reached, unless the last word is rejection."""
    rank = F.when(F.col("event") == "seen", 1).when(F.col("event") == "reviewed", 2).when(F.col("event") == "gray", 3).when(F.col("event") == "active", 4).otherwise(0)
    state = events.groupBy("term").agg(F.max(rank).alias("reached"), F.max_by("event", "seq").alias("last"))
    stage = F.when(F.col("last") == "rejected", "REJECTED").when(F.col("reached") >= 4, "ACTIVE").when(F.col("reached") == 3, "GRAY").when(F.col("reached") == 2, "REVIEWED").otherwise("NEW")
    return state.select("term", stage.alias("stage"))


def parse_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds hours, cross_source, entity kinds and confidence of questions."""
    low = F.lower(text)
    kinds = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in (("email", "e-?mail"), ("phone", "phone|call"), ("domain", "domain|site|url"), ("account", "account|handle"))]))
    hours = T.phrase_hours(F.col(text))
    cross = low.rlike("cross[- ]source|several sources|multiple sources")
    return queries.withColumns({"hours": hours, "cross_source": cross, "kinds": kinds, "confidence": F.round(F.least(F.lit(0.95), 0.35 + 0.2 * F.size(kinds) + F.when(hours.isNotNull(), 0.2).otherwise(0.0) + F.when(cross, 0.15).otherwise(0.0)), 4)})
