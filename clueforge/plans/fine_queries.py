"""Fine classification over `documents`, and the same rule rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.operators import fine as N
from clueforge.operators import records as R
from clueforge.plans.record_queries import CLASSIFIED, classified
from clueforge.registry import register
from clueforge.rules import FIXTURE

#: A pack whose rows of each kind hold for some of the invented texts.
PACK = N.FinePack(
    base=FIXTURE,
    priority={"credential": 4, "contact": 3, "insult": 2, "prose": 1},
    themes={"src1": "contact", "src2": "insult"},
    contexts=(
        N.Context("licence_notice", ("license", "copyright", "permission", "warranty"), 2),
        N.Context("order_number", ("order", "invoice", "part"), 1, trigger=("no", "number"), forbid=("token",), no_deal=True),
        N.Context("plain_spanish", (" que ", " los ", " las ", " con "), 3, confirm=(" en ",), forbid=("password", "@mail"), no_links=True),
    ),
    late_contexts=(N.Context("plain_german", (" und ", " der ", " die "), 3, no_contact=False), N.Context("plain_french", (" les ", " des ", " est "), 3)),
    plain_contexts=(N.Context("letters_only", ("e",), 1, forbid=("@", "+1"), no_links=True),),
    modifiers=(
        N.Modifier("credential_with_contact", (("token", "password"), ("@mail", "+1 (")), "add", "credential", 2),
        N.Modifier("key_delivery", (("akia",), ("token", "password")), "max", "credential", 4, unless=("license",)),
        N.Modifier("greeting", ((" hand", " heed"), (" the ",)), "drop", "insult"),
        N.Modifier("prose_of_contact", (("example.com",), (" the ", " und ")), "drop", "prose", unless=("token",)),
        N.Modifier("mail_only", (("@mail",),), "add", "contact", 1, unless=("+1 (",)),
    ),
    contact_marks=("@mail", "+1 ("),
    contact_verbs=("call", "write", "mail", " con "),
    intents=("order", "token", " con "),
    support=("password", "akia"),
    operation=("akia", "operation"),
    solicitation=("@mail", "password"),
    workflow=("akia",),
    review_only=("insult",),
    review_only_labels=("phone",),
)

_low = "lower(t)"
_any = lambda terms: "(" + " OR ".join(f"contains({_low}, '{t}')" for t in terms) + ")" if terms else "false"
_count = lambda terms: "(" + " + ".join(f"contains({_low}, '{t}')::INT" for t in terms) + ")"
_contact = f"({_any(PACK.contact_marks)} AND {_any(PACK.contact_verbs)})"
_deal = f"({_any(PACK.intents)} AND ({_any(PACK.contact_marks)} OR {_any(PACK.support)} OR regexp_matches({_low}, '{PACK.price}')))"


def _context(c: N.Context) -> str:
    parts = [f"{_count(c.markers)} >= {c.least}", *[_any(x) for x in (c.trigger, c.confirm) if x]]
    parts += [f"NOT {_any(c.forbid)}"] * bool(c.forbid) + [f"NOT {_contact}"] * c.no_contact + [f"NOT {_deal}"] * c.no_deal + [f"NOT regexp_matches({_low}, 'https?://')"] * c.no_links
    return "(" + " AND ".join(parts) + ")"


def _first(contexts: tuple[N.Context, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {_context(c)} THEN '{c.name}'" for c in contexts) + " END"


_fits = {m.name: " AND ".join([*map(_any, m.when), *([f"NOT {_any(m.unless)}"] if m.unless else [])]) for m in PACK.modifiers}
_names = sorted(FIXTURE.categories)


def _score(category: str) -> str:
    out = f"base_{category}"
    for m in PACK.modifiers:
        if m.category == category:
            fits = f"({_fits[m.name]})::INT"
            out = f"({out} + {m.value} * {fits})" if m.how == "add" else f"greatest({out}, {m.value} * {fits})" if m.how == "max" else f"({out} * (1 - {fits}))"
    return out


_themed = {c: " OR ".join(f"source_name = '{t}'" for t, k in PACK.themes.items() if k == c) or "false" for c in _names}
_asks = _any(FIXTURE.solicitation)
_negations = "|".join(rf"\b{n}\b" for n in FIXTURE.negation)
_near = lambda term: f"""(NOT contains({_low}, '{term}') OR list_bool_and(list_transform(range(1, len(string_split({_low}, '{term}'))), lambda i: regexp_matches(right(string_split({_low}, '{term}')[i], 12), '{_negations}') OR regexp_matches(left(string_split({_low}, '{term}')[i + 1], 8), '{_negations}'))))"""
POLARITY = f"CASE WHEN {_asks} AND NOT denied AND has_contact THEN 'solicitation' WHEN {_any(FIXTURE.defensive)} THEN 'defensive' WHEN {_asks} AND denied THEN 'negated' WHEN {_asks} THEN 'solicitation' ELSE 'neutral' END"
DENIED = " AND ".join(map(_near, FIXTURE.solicitation))
_label = lambda c: "list_max([" + ", ".join(f"{{'n': {_count(tuple(t.lower() for t in terms))}, 'label': '{label}'}}" for label, terms in FIXTURE.secondary[c].items()) + "])"
SCORED = f"""{CLASSIFIED}, polar AS (SELECT *, {POLARITY} AS polarity FROM (SELECT *, {DENIED} AS denied FROM bucketed)), bases AS (
  SELECT *, {", ".join(f"{_count(tuple(t.lower() for t in FIXTURE.categories[c]))} AS keywords_{c}" for c in _names)} FROM polar
), themed AS (SELECT *, {", ".join(f"keywords_{c} + 2 * ({_themed[c]})::INT AS base_{c}" for c in _names)} FROM bases
), modified AS (SELECT *, {", ".join(f"{_score(c)}::INT AS score_{c}" for c in _names)} FROM themed
)"""
FINE = f"""{SCORED}, ranked AS (
  SELECT *, list_sort(list_filter([{", ".join(f"{{'s': -score_{c}, 'p': {-PACK.priority[c]}, 'c': '{c}'}}" for c in _names)}], lambda x: x.s < 0)) AS r,
         CASE WHEN NOT {_any(PACK.operation)} THEN coalesce({_first(PACK.contexts)}, CASE WHEN NOT {_any(PACK.solicitation)} THEN {_first(PACK.late_contexts)} END) END AS benign, {_first(PACK.plain_contexts)} AS plain FROM modified
), topped AS (
  SELECT *, r[1].c AS ftop, -r[1].s AS fscore, list_transform(list_filter(r[2:], lambda x: x.s = r[1].s OR (x.s - r[1].s <= 1 AND x.s <= -2)), lambda x: x.c) AS rivals,
         CASE r[1].c {" ".join(f"WHEN '{c}' THEN {_label(c)}" for c in FIXTURE.secondary)} END AS best, CASE r[1].c {" ".join(f"WHEN '{c}' THEN keywords_{c} = 0" for c in _names)} ELSE false END AS only_theme FROM ranked
), labelled AS (
  SELECT *, CASE WHEN best.n > 0 THEN best.label ELSE 'unrefined' END AS label, CASE WHEN best.n > 0 THEN best.n ELSE 0 END AS support, len(coalesce(rivals, [])) > 0 AS clash,
         CASE WHEN ftop IS NOT NULL AND benign IS NOT NULL THEN 'benign' WHEN ftop IS NULL AND plain IS NOT NULL THEN 'plain' WHEN ftop IS NULL THEN 'none' WHEN ({_any(FIXTURE.defensive)} OR polarity IN ('negated', 'defensive')) AND NOT {_any(PACK.workflow)} THEN 'defensive' ELSE 'risk' END AS kind FROM topped
), capped AS (
  SELECT *, least(greatest(confidence, least(0.96::DOUBLE, 0.56::DOUBLE + fscore * 0.07::DOUBLE + support * 0.03::DOUBLE)), CASE WHEN only_theme THEN 0.72::DOUBLE ELSE 1 END, CASE WHEN label IN ('phone') THEN 0.78::DOUBLE ELSE 1 END, CASE WHEN clash THEN 0.74::DOUBLE ELSE 1 END) AS cap FROM labelled
), reasoned AS (
  SELECT *, CASE kind WHEN 'benign' THEN 'ordinary_public_context_overrode_homonym_risk' WHEN 'plain' THEN 'ordinary_public_information_no_risk_signal' WHEN 'none' THEN 'no_category_score' WHEN 'defensive' THEN 'defensive_or_negative_context'
    ELSE CASE WHEN label <> 'unrefined' AND cap >= 0.85 AND support >= 2 AND NOT clash AND NOT only_theme THEN 'high_confidence_auto_clear' WHEN clash THEN 'category_conflict' WHEN label IN ('phone') THEN 'review_only_secondary_label'
      WHEN label = 'unrefined' THEN 'secondary_label_unresolved' WHEN only_theme THEN 'theme_only_evidence' WHEN ftop IN ('insult') THEN 'review_only_category' WHEN review_required THEN 'fast_classifier_review' ELSE 'auto_resolved' END END AS fine_reason,
    CASE kind WHEN 'none' THEN 'unknown' WHEN 'risk' THEN ftop ELSE 'normal_noise' END AS fine_category, CASE kind WHEN 'none' THEN 'pending' WHEN 'risk' THEN label WHEN 'defensive' THEN 'defensive_context' ELSE 'low_relevance' END AS fine_label,
    round(CASE kind WHEN 'benign' THEN 0.76 WHEN 'plain' THEN 0.72 WHEN 'none' THEN 0.35 WHEN 'defensive' THEN 0.8 ELSE cap END, 4)::DOUBLE AS fine_confidence,
    CASE kind WHEN 'none' THEN 'UNKNOWN' WHEN 'defensive' THEN 'NEGATIVE_RISK_ASSERTION' WHEN 'risk' THEN CASE WHEN clash THEN 'CONFLICT_REVIEW' ELSE 'RESOLVED' END ELSE 'RESOLVED' END AS fine_conflict,
    CASE WHEN kind = 'risk' THEN array_to_string(rivals, ',') ELSE '' END AS conflicts, CASE kind WHEN 'benign' THEN 'ordinary_context:' || benign WHEN 'plain' THEN 'ordinary_context:' || plain END AS evidence_context FROM capped
), fine AS (
  SELECT *, fine_reason IN ('category_conflict', 'review_only_secondary_label', 'secondary_label_unresolved', 'theme_only_evidence', 'review_only_category', 'fast_classifier_review', 'no_category_score') AS fine_review FROM reasoned
), reviewed AS (
  SELECT *, CASE WHEN kind IN ('benign', 'plain', 'defensive') THEN 'LOW_RELEVANCE' WHEN NOT fine_review THEN 'AUTO_RESOLVED' WHEN fine_category = 'unknown' OR fine_confidence < 0.5 OR fine_conflict = 'CONFLICT_REVIEW' THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'SAMPLE_REVIEW' END AS fine_bucket FROM fine
)"""


def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.polarity(classified(spark, sf_dir), FIXTURE)


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.classify_fine(polar(spark, sf_dir).withColumn("themes", F.array("source_name")), PACK, "themes")


@register("dom_polarity", f"WITH {CLASSIFIED} SELECT trace_id, {POLARITY} AS polarity FROM (SELECT *, {DENIED} AS denied FROM bucketed)")
def dom_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polar(spark, sf_dir).select("trace_id", "polarity")


@register("fn_locally_negated", f"WITH {CLASSIFIED} SELECT trace_id, {DENIED} AS denied FROM bucketed")
def fn_locally_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clueforge.functions import text as T

    denied = F.lit(True)
    for term in FIXTURE.solicitation:
        denied = denied & (~F.lower("clean_text").contains(term) | T.negated(F.lower("clean_text"), term, tuple(rf"\b{n}\b" for n in FIXTURE.negation)))
    return classified(spark, sf_dir).select("trace_id", denied.alias("denied"))


@register("dom_score_modifiers", f"WITH {SCORED} SELECT trace_id, {', '.join(f'score_{c}' for c in _names)}, array_to_string(list_filter([{', '.join(f'CASE WHEN {_fits[m.name]} THEN {chr(39)}{m.name}{chr(39)} END' for m in PACK.modifiers)}], lambda x: x IS NOT NULL), ',') AS modifiers FROM modified")
def dom_score_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = N.category_scores(polar(spark, sf_dir).withColumn("themes", F.array("source_name")), PACK, "themes")
    return N.modified(df, PACK).select("trace_id", *[f"score_{c}" for c in _names], F.array_join("modifiers", ",").alias("modifiers"))


@register("dom_benign_context", f"WITH {FINE} SELECT trace_id, benign, plain FROM ranked")
def dom_benign_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("clean_text")
    return classified(spark, sf_dir).select("trace_id", N.benign_context(low, PACK).alias("benign"), N.plain_context(low, PACK).alias("plain"))


_columns = ("fine_category", "fine_label", "fine_confidence", "fine_review", "fine_bucket", "fine_conflict", "conflicts", "fine_reason", "evidence_context")


@register("dom_classify_fine", f"WITH {FINE} SELECT trace_id, {', '.join(_columns)} FROM reviewed")
def dom_classify_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fine(spark, sf_dir).select("trace_id", *_columns)


@register("agg_counter_fine", f"WITH {FINE} SELECT fine_category, fine_reason, count(*) AS n FROM reviewed GROUP BY ALL")
def agg_counter_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fine(spark, sf_dir).groupBy("fine_category", "fine_reason").agg(F.count("*").alias("n"))
