"""Mentions of entities with their places: patterns, dictionary terms and variant spellings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.functions import text as T
from clueforge.operators.graph import PATTERNS, normalize_entity


@dataclass(frozen=True)
class Variant:
    """A family of variant spellings: a pattern, what it stands for, and words that confirm it near by (or anywhere, with `reach` 0)."""

    name: str
    pattern: str
    plain: str
    cues: tuple[str, ...] = ()
    reach: int = 24
    confidence: float = 0.86


def dictionary_hits(text: str, terms: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Places of terms (any case), longer terms first; a place belongs to one term only."""
    low, taken, found = text.lower(), bytearray(len(text)), []
    if len(low) != len(text):  # lower case that changes the length has no places in the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        at = low.find(term.lower())
        while at >= 0:
            if not any(taken[at : at + len(term)]):
                found.append((term, at, at + len(term)))
                taken[at : at + len(term)] = b"\x01" * len(term)
            at = low.find(term.lower(), at + len(term))
    return sorted(found, key=lambda x: x[1:])


def variant_hits(text: str, variants: tuple[Variant, ...]) -> list[tuple[Variant, int, int, bool]]:
    """Places of variant spellings in the order of the families, no two overlapping, and whether their context confirms them."""
    low, taken, found = text.lower(), bytearray(len(text)), []
    for v in variants:
        for m in re.finditer(v.pattern, text, re.IGNORECASE):
            a, b = m.span()
            if a == b or any(taken[a:b]):
                continue
            taken[a:b] = b"\x01" * (b - a)
            around = low[max(0, a - v.reach) : b + v.reach] if v.reach else low
            found.append((v, a, b, not v.cues or any(c in around for c in v.cues)))
    return sorted(found, key=lambda x: x[1:3])


def expanded(text: str, variants: tuple[Variant, ...]) -> str:
    """The text with confirmed variants in their plain forms."""
    out, at = [], 0
    for v, a, b, confirmed in variant_hits(text, variants):
        if confirmed:
            out += [text[at:a], v.plain]
            at = b
    return "".join([*out, text[at:]])


_MENTION = "entity_type string, entity_value string, start long, stop long, method string, confidence double, confirmed boolean"


def mentions(records: DataFrame, terms: dict[str, str] | None = None, variants: tuple[Variant, ...] = (), patterns: dict[str, str] | None = None) -> DataFrame:
    """One row for each mention in clean_text: trace_id, source_name, entity_type, entity_value, start, stop, method, confidence, confirmed.

    Places count code points, ends are exclusive. Patterns are Python's. Null and
    empty texts have no mentions; repeated records have theirs each.
    """
    words = tuple(terms or ())
    compiled = [(k, re.compile(p.replace(r"(?:\G|(?<!", "(?:(?<!"), re.ASCII)) for k, p in (PATTERNS if patterns is None else patterns).items()]
    key = records.schema["trace_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trace, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                rows += [(trace, source, k, m[0], m.start(), m.end(), "pattern", 1.0, True) for k, p in compiled for m in p.finditer(text)]
                rows += [(trace, source, "slang_term", text[a:b], a, b, "slang_dictionary", 0.88, True) for _, a, b in dictionary_hits(text, words)]
                rows += [(trace, source, "slang_variant", text[a:b], a, b, f"variant_{v.name}", v.confidence, ok) for v, a, b, ok in variant_hits(text, variants)]
            names = ["trace_id", "source_name", *[x.split()[0] for x in _MENTION.split(", ")]]
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return records.select("trace_id", "source_name", "clean_text").mapInArrow(found, f"trace_id {key}, source_name string, {_MENTION}")


def extract_advanced(records: DataFrame, terms: dict[str, str], variants: tuple[Variant, ...] = ()) -> DataFrame:
    """Mentions with normalised values, the first of each (record, type, value): patterns, then dictionary, then confirmed variants."""
    plain = F.create_map(*[F.lit(x) for kv in [*((k.lower(), v) for k, v in terms.items()), ("", "")] for x in kv])
    found = mentions(records, terms, variants).where("confirmed")
    value = F.when(F.col("entity_type") == "slang_term", F.try_element_at(plain, F.lower("entity_value"))).otherwise(normalize_entity(F.col("entity_type"), F.col("entity_value")))
    for v in variants:
        value = F.when(F.col("method") == f"variant_{v.name}", v.plain).otherwise(value)
    found = found.withColumn("normalized", value).where("normalized is not null and normalized <> ''")
    turn = F.when(F.col("method") == "pattern", 0).when(F.col("method") == "slang_dictionary", 1).otherwise(2)
    first = found.groupBy("trace_id", "source_name", "entity_type", "normalized").agg(F.min(F.struct(turn.alias("turn"), F.col("start"), F.col("stop"), F.col("entity_value"), F.col("method"), F.col("confidence"))).alias("m"))
    return first.select("trace_id", "source_name", "entity_type", "normalized", "m.entity_value", "m.start", "m.stop", "m.method", "m.confidence", T.mask(F.col("normalized")).alias("masked"))


#: Types by priority, for the order of a record's entities.
PRIORITY = ("access_key", "email", "phone", "ip", "domain", "slang_term", "slang_variant")


def post_processed(found: DataFrame, records: DataFrame, references: str = "order|invoice|ticket|serial|no\\.", prefix: int = 16) -> DataFrame:
    """Entities retyped by the 16 characters before them, without made-up values and the source's own name, numbered by priority and place.

    A phone after a word of reference is a reference_number; a value of one or two
    distinct characters is made up.
    """
    text = records.select("trace_id", "clean_text")
    df = found.join(text, "trace_id")
    before = F.substring("clean_text", F.greatest(F.col("start") - prefix, F.lit(0)).cast("int") + 1, F.least(F.col("start"), F.lit(prefix)).cast("int"))
    kind = F.when((F.col("entity_type") == "phone") & F.lower(before).rlike(references), "reference_number").otherwise(F.col("entity_type"))
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace("normalized", "[^A-Za-z0-9]", ""), "")))
    df = df.withColumn("entity_type", kind).where((distinct > 2) & (F.lower("normalized") != F.lower("source_name"))).drop("clean_text")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("entity_type")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    return df.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(rank, "start", "stop", "normalized")))


def merged_entities(rule: DataFrame, model: DataFrame) -> DataFrame:
    """The union of a rule's and a model's entities by (trace_id, entity_type, normalized); the rule's row wins, `origin` tells who found it."""
    rows = rule.withColumn("origin", F.lit("rule")).unionByName(model.withColumn("origin", F.lit("model")), allowMissingColumns=True)
    best = rows.groupBy("trace_id", "entity_type", "normalized").agg(F.max_by("confidence", F.col("origin") == "rule").alias("confidence"), F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origin"))
    return best


def near_terms(queries: DataFrame, terms: dict[str, str], least: float = 0.25, limit: int = 3) -> DataFrame:
    """For each query (query_id, term) the most similar dictionary terms: character similarity, at least 0.92 where the query holds the term."""
    from difflib import SequenceMatcher

    key = queries.schema["query_id"].dataType.simpleString()
    known = sorted({k.lower(): v for k, v in terms.items()}.items())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, got = (term or "").lower(), []
                for word, plain in known:
                    score = SequenceMatcher(None, low, word).ratio()
                    score = max(score, 0.92) if word in low else score
                    if score >= least:
                        got.append((-round(score, 4), word, plain))
                rows += [(query, i + 1, w, p, -s) for i, (s, w, p) in enumerate(sorted(got)[:limit])]
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["query_id", "rank", "term", "plain", "score"])

    return queries.select("query_id", "term").mapInArrow(scored, f"query_id {key}, rank int, term string, plain string, score double")


def contextual(found: DataFrame, records: DataFrame, cues: tuple[str, ...]) -> DataFrame:
    """Adds context_relevance of each mention."""
    joined = found.join(records.select("trace_id", "clean_text"), "trace_id")
    return joined.withColumn("context_relevance", T.context_relevance(F.col("clean_text"), F.col("start").cast("int"), F.col("stop").cast("int"), cues)).drop("clean_text")


def prompt_coverage(answer: Column, requirements: tuple[str, ...]) -> Column:
    """The share of requirements that an answer names."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.round(sum((low.contains(r.lower()).cast("int") for r in requirements), F.lit(0)) / len(requirements), 4) if requirements else F.lit(1.0)
