"""Fine classification: scores with declared modifiers, ordinary contexts, conflicts, confidence caps and review reasons.

Every predicate is a row of a pack and compiles to one boolean column, so the
whole classifier is a projection: one scan, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.rules import RulePack


@dataclass(frozen=True)
class Context:
    """An ordinary context: enough markers and a trigger, without what is forbidden."""

    name: str
    markers: tuple[str, ...]
    least: int = 1
    trigger: tuple[str, ...] = ()
    confirm: tuple[str, ...] = ()
    forbid: tuple[str, ...] = ()
    no_contact: bool = True
    no_deal: bool = False
    no_links: bool = False


@dataclass(frozen=True)
class Modifier:
    """A change of a category's score where each of the groups of terms `when` has a hit and none of `unless` has: add, max or drop."""

    name: str
    when: tuple[tuple[str, ...], ...]
    how: str
    category: str
    value: int = 0
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class FinePack:
    """What the fine classifier knows of a domain, on top of a rule pack."""

    base: RulePack
    priority: dict[str, int]
    themes: dict[str, str] = field(default_factory=dict)
    contexts: tuple[Context, ...] = ()
    late_contexts: tuple[Context, ...] = ()
    plain_contexts: tuple[Context, ...] = ()
    modifiers: tuple[Modifier, ...] = ()
    contact_marks: tuple[str, ...] = ()
    contact_verbs: tuple[str, ...] = ()
    intents: tuple[str, ...] = ()
    support: tuple[str, ...] = ()
    price: str = r"[$€£] ?[0-9]+|[0-9]+ ?(?:usd|eur)"
    operation: tuple[str, ...] = ()
    solicitation: tuple[str, ...] = ()
    workflow: tuple[str, ...] = ()
    review_only: tuple[str, ...] = ()
    review_only_labels: tuple[str, ...] = ()


def any_of(low: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | low.contains(term)
    return found


def count_of(low: Column, terms: tuple[str, ...]) -> Column:
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def direct_contact(low: Column, pack: FinePack) -> Column:
    """A contact mark together with a verb that asks for contact."""
    return any_of(low, pack.contact_marks) & any_of(low, pack.contact_verbs)


def hard_deal(low: Column, pack: FinePack) -> Column:
    """An intent to trade with a contact mark, a term of support or a price."""
    return any_of(low, pack.intents) & (any_of(low, pack.contact_marks) | any_of(low, pack.support) | low.rlike(pack.price))


def in_context(low: Column, context: Context, pack: FinePack) -> Column:
    out = count_of(low, context.markers) >= context.least
    for terms in (context.trigger, context.confirm):
        if terms:
            out = out & any_of(low, terms)
    if context.forbid:
        out = out & ~any_of(low, context.forbid)
    if context.no_contact:
        out = out & ~direct_contact(low, pack)
    if context.no_deal:
        out = out & ~hard_deal(low, pack)
    return out & ~low.rlike("https?://") if context.no_links else out


def benign_context(low: Column, pack: FinePack) -> Column:
    """The name of the first ordinary context, or null.

    A sign of business operation vetoes all. The late contexts hold only where
    nothing is solicited.
    """
    first, late = F.lit(None).cast("string"), F.lit(None).cast("string")
    for context in reversed(pack.contexts):
        first = F.when(in_context(low, context, pack), context.name).otherwise(first)
    for context in reversed(pack.late_contexts):
        late = F.when(in_context(low, context, pack), context.name).otherwise(late)
    return F.when(~any_of(low, pack.operation), F.coalesce(first, F.when(~any_of(low, pack.solicitation), late)))


def plain_context(low: Column, pack: FinePack) -> Column:
    """The ordinary context of a text without any score, or null."""
    out = F.lit(None).cast("string")
    for context in reversed(pack.plain_contexts):
        out = F.when(in_context(low, context, pack), context.name).otherwise(out)
    return out


def category_scores(df: DataFrame, pack: FinePack, themes: str | None = None) -> DataFrame:
    """Adds keywords_<category> and score_<category>: keyword hits and two for a matching theme, before modifiers."""
    low = F.lower("clean_text")
    names = F.col(themes) if themes else F.array().cast("array<string>")
    keywords = {f"keywords_{c}": count_of(low, tuple(t.lower() for t in terms)) for c, terms in pack.base.categories.items()}
    df = df.withColumns(keywords)
    bonus = lambda c: F.arrays_overlap(names, F.array(*[F.lit(t) for t, k in pack.themes.items() if k == c])).cast("int") * 2 if c in pack.themes.values() else F.lit(0)
    return df.withColumns({f"score_{c}": F.col(f"keywords_{c}") + F.coalesce(bonus(c), F.lit(0)) for c in pack.base.categories})


def modified(df: DataFrame, pack: FinePack) -> DataFrame:
    """Applies the modifiers, in order, to score_<category>; adds the names of those that held as `modifiers`."""
    low = F.lower("clean_text")
    scores = {c: F.col(f"score_{c}") for c in pack.base.categories}
    held = []
    for m in pack.modifiers:
        fits = F.lit(True)
        for terms in m.when:
            fits = fits & any_of(low, terms)
        if m.unless:
            fits = fits & ~any_of(low, m.unless)
        held.append(F.when(fits, F.lit(m.name)))
        now = scores[m.category]
        change = lambda value, other, fits=fits: F.when(fits, value).otherwise(other)
        scores[m.category] = now + change(m.value, 0) if m.how == "add" else F.greatest(now, change(m.value, 0)) if m.how == "max" else now * change(0, 1)
    named = F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")
    return df.withColumns({f"score_{c}": s.cast("int") for c, s in scores.items()} | {"modifiers": named})


def classify_fine(df: DataFrame, pack: FinePack, themes: str | None = None) -> DataFrame:
    """Adds fine_category, fine_label, fine_confidence, fine_review, fine_bucket, fine_conflict, conflicts and fine_reason.

    `df` has clean_text and, from the fast classifier and the polarity scorer,
    confidence, review_required and polarity.
    """
    names = sorted(pack.base.categories)
    df = modified(category_scores(df, pack, themes), pack)
    low = F.lower("clean_text")
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"score_{c}")).alias("s"), F.lit(-pack.priority.get(c, 0)).alias("p"), F.lit(c).alias("c")) for c in names]), lambda x: x["s"] < 0))
    df = df.withColumns({"_ranked": ranked, "_benign": benign_context(low, pack), "_plain": plain_context(low, pack), "_defends": any_of(low, pack.base.defensive) | F.col("polarity").isin("negated", "defensive"), "_works": any_of(low, pack.workflow)})
    df = df.withColumns({"_top": F.try_element_at("_ranked", F.lit(1))})
    top = -F.col("_top.s")
    rivals = F.filter(F.slice("_ranked", 2, len(names)), lambda x: (x["s"] == F.col("_top.s")) | ((x["s"] - F.col("_top.s") <= 1) & (x["s"] <= -2)))
    labels = [F.when(F.col("_top.c") == c, F.struct(count_of(low, tuple(t.lower() for t in terms)).alias("n"), F.lit(label).alias("label"))) for c, found in pack.base.secondary.items() for label, terms in found.items()]
    df = df.withColumns({"_score": top, "_rivals": F.transform(rivals, lambda x: x["c"]), "_best": F.array_max(F.array_compact(F.array(*labels)))})
    only_theme = F.lit(False)
    for c in names:
        only_theme = only_theme | ((F.col("_top.c") == c) & (F.col(f"keywords_{c}") == 0))
    label = F.when(F.col("_best.n") > 0, F.col("_best.label")).otherwise("unrefined")
    df = df.withColumns({"_label": label, "_only_theme": only_theme, "_support": F.when(F.col("_best.n") > 0, F.col("_best.n")).otherwise(0)})
    kind = (
        F.when(F.col("_top").isNotNull() & F.col("_benign").isNotNull(), "benign")
        .when(F.col("_top").isNull() & F.col("_plain").isNotNull(), "plain")
        .when(F.col("_top").isNull(), "none")
        .when(F.col("_defends") & ~F.col("_works"), "defensive")
        .otherwise("risk")
    )
    df = df.withColumn("_kind", kind)
    clash = F.size("_rivals") > 0
    raw = F.greatest(F.col("confidence"), F.least(F.lit(0.96), 0.56 + F.col("_score") * 0.07 + F.col("_support") * 0.03))
    capped = F.least(raw, F.when(F.col("_only_theme"), 0.72).otherwise(1.0), F.when(F.col("_label").isin(*pack.review_only_labels), 0.78).otherwise(1.0), F.when(clash, 0.74).otherwise(1.0))
    clear = (F.col("_label") != "unrefined") & (capped >= 0.85) & (F.col("_support") >= 2) & ~clash & ~F.col("_only_theme")
    reason = (
        F.when(clear, "high_confidence_auto_clear")
        .when(clash, "category_conflict")
        .when(F.col("_label").isin(*pack.review_only_labels), "review_only_secondary_label")
        .when(F.col("_label") == "unrefined", "secondary_label_unresolved")
        .when(F.col("_only_theme"), "theme_only_evidence")
        .when(F.col("_top.c").isin(*pack.review_only), "review_only_category")
        .when(F.col("review_required"), "fast_classifier_review")
        .otherwise("auto_resolved")
    )
    by_kind = lambda values, other: F.coalesce(*[F.when(F.col("_kind") == k, v) for k, v in values.items()], other)
    df = df.withColumns(
        {
            "fine_category": by_kind({"benign": F.lit("normal_noise"), "plain": F.lit("normal_noise"), "none": F.lit("unknown"), "defensive": F.lit("normal_noise")}, F.col("_top.c")),
            "fine_label": by_kind({"benign": F.lit("low_relevance"), "plain": F.lit("low_relevance"), "none": F.lit("pending"), "defensive": F.lit("defensive_context")}, F.col("_label")),
            "fine_confidence": F.round(by_kind({"benign": F.lit(0.76), "plain": F.lit(0.72), "none": F.lit(0.35), "defensive": F.lit(0.8)}, capped), 4),
            "fine_reason": by_kind({"benign": F.lit("ordinary_public_context_overrode_homonym_risk"), "plain": F.lit("ordinary_public_information_no_risk_signal"), "none": F.lit("no_category_score"), "defensive": F.lit("defensive_or_negative_context")}, reason),
            "fine_conflict": by_kind({"benign": F.lit("RESOLVED"), "plain": F.lit("RESOLVED"), "none": F.lit("UNKNOWN"), "defensive": F.lit("NEGATIVE_RISK_ASSERTION")}, F.when(clash, "CONFLICT_REVIEW").otherwise("RESOLVED")),
            "conflicts": F.when(F.col("_kind") == "risk", F.array_join("_rivals", ",")).otherwise(""),
            "evidence_context": F.when(F.col("_kind") == "benign", F.concat(F.lit("ordinary_context:"), "_benign")).when(F.col("_kind") == "plain", F.concat(F.lit("ordinary_context:"), "_plain")),
        }
    )
    review = F.col("fine_reason").isin("category_conflict", "review_only_secondary_label", "secondary_label_unresolved", "theme_only_evidence", "review_only_category", "fast_classifier_review", "no_category_score")
    bucket = F.when(F.col("_kind").isin("benign", "plain", "defensive"), "LOW_RELEVANCE").when(~review, "AUTO_RESOLVED").when((F.col("fine_category") == "unknown") | (F.col("fine_confidence") < 0.5) | (F.col("fine_conflict") == "CONFLICT_REVIEW"), "HUMAN_REVIEW_REQUIRED").otherwise("SAMPLE_REVIEW")
    return df.withColumns({"fine_review": review, "fine_bucket": bucket}).drop(*[c for c in df.columns if c.startswith("_")])
