"""Text functions and scores as column expressions, and one Arrow pass for character statistics."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ZERO_WIDTH = "[​-‏﻿]"
#: Characters that compatibility normalisation leaves as they are in composed texts.
STABLE = r"\A[\x00-\x7FÀ-ÿ]*+\z"

#: Runs of white space that are not one space each.
LOOSE = r"[\s \u0085&&[^ ]][\s \u0085]*+| [\s \u0085]++"


def normalize_text(text: Column) -> Column:
    """Zero-width characters go, white space collapses, ends are trimmed; null is empty.

    For texts of stable characters this is all of NFKC normalisation;
    `compatible` treats the others, before this.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(bare, LOOSE, " "))


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation (NFKC); nulls stay."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(text: Column) -> Column:
    """A text after compatibility normalisation; of texts of stable characters only a null leaves the JVM."""
    return F.coalesce(composed(F.when(~text.rlike(STABLE), text)), text)


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """Compatibility-normalise a column, in the same scan."""
    return df.withColumn(column, compatible(F.col(column)))


def canonical(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(normalize_text(text)), r"[^\p{L}\p{N}]", "")


def dedup_id(text: Column) -> Column:
    return F.concat(F.lit("dedup:"), F.substring(F.sha1(canonical(text)), 1, 16))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The distinct character n-grams; a text of at most n characters is its own only one."""
    places = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.element_at(c, i + k) for k in range(n)]))
    grams = F.transform(F.array(F.split(text, "")), places)[0]
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


#: The type of character statistics; an object, since a text needs a session to be parsed.
STATS = StructType([StructField(n, LongType()) for n in ("visible", "signal", "broken", "top")] + [StructField("entropy", DoubleType())])


#: Characters of a batch that are worked through together.
TOGETHER = 4_000_000
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)


@F.pandas_udf(STATS)
def char_stats(texts: pd.Series) -> pd.DataFrame:
    """Counts of visible, letter-or-digit, replacement and commonest characters, and the entropy of the visible ones."""
    names = ["visible", "signal", "broken", "top", "entropy"]
    values = [x or "" for x in texts]
    sizes = np.array([len(x) for x in values], np.int64)
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        codes = np.frombuffer("".join(values[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(b - a), sizes[a:b])
        seen = ~np.isin(codes, _SPACES)
        key, n = np.unique(row[seen] * 0x110000 + codes[seen], return_counts=True)
        row, code = key // 0x110000, key % 0x110000
        kinds, where = np.unique(code, return_inverse=True)
        letters = np.array([chr(c).isalnum() for c in kinds.tolist()], bool)[where] if len(kinds) else np.zeros(0, bool)
        visible = np.bincount(row, n, b - a)
        top = np.zeros(b - a)
        np.maximum.at(top, row, n)
        p = n / np.maximum(visible, 1)[row]
        entropy = np.bincount(row, -p * np.log2(p), b - a)
        out.append(pd.DataFrame(dict(zip(names, (visible, np.bincount(row, n * letters, b - a), np.bincount(row, n * (code == 0xFFFD), b - a), top, entropy), strict=True))))
    found = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)
    return found.astype(dict.fromkeys(names[:4], "int64") | {"entropy": "float64"})


def noise_score(stats: Column) -> Column:
    """0 to 1 from character statistics; blank texts are 1."""
    n = stats["visible"].cast("double")
    repeat = stats["top"] / n
    score = F.greatest(
        stats["broken"] / n,
        1 - stats["signal"] / n,
        F.when((repeat >= 0.8) & (n >= 8), repeat).otherwise(0.0),
        F.when((n <= 4) & (stats["signal"] == 0), 1.0).otherwise(0.0),
    )
    return F.when(stats["visible"] == 0, 1.0).otherwise(F.round(F.least(score, F.lit(1.0)), 4))


def quality_score(length: Column, entropy: Column, risk: Column, noise: Column) -> Column:
    """0 to 1 from canonical length, entropy, risk and noise."""
    raw = 0.20 + 0.28 * F.least(length / 80.0, F.lit(1.0)) + 0.22 * F.least(entropy / 3.5, F.lit(1.0)) + 0.30 * risk - 0.45 * noise
    return F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 4)


def excerpt(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def excerpt_around(text: Column, term: str, reach: int = 60) -> Column:
    """Up to `reach` characters before and after the first place of a term."""
    at = F.instr(text, term)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(term) + reach))


def domain_of(url: Column) -> Column:
    """The host of a possibly defanged address, without scheme, path and port."""
    plain = F.regexp_replace(F.replace(F.lower(F.trim(url)), F.lit("[.]"), F.lit(".")), "^hxxp", "http")
    return F.regexp_replace(F.regexp_replace(plain, "^[a-z][a-z0-9+.-]*://", ""), "[/?#:].*$", "")


def mask(value: Column) -> Column:
    """The first two and the last two characters of values of over six, else stars."""
    return F.when(F.length(value) > 6, F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, -2, 2))).otherwise(F.lit("***"))


#: An e-mail address; a match begins where the run of its first characters does, so long runs without an address are passed over once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: The same for engines that are linear by themselves.
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Fixed order: later patterns see what earlier ones left.
PII = (
    ("[email]", EMAIL),
    ("[ip]", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("[phone]", r"\+[0-9][ ().0-9-]{7,18}[0-9]"),
    ("[card]", r"\b[0-9](?:[ -]?[0-9]){12,18}\b"),
)


SQL_PII = (("[email]", EMAIL_SQL), *PII[1:])


def mask_pii(text: Column) -> Column:
    for label, pattern in PII:
        text = F.regexp_replace(text, pattern, label)
    return text


def hash_pii(value: Column, salt: str = "clueforge") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), value), 256)


#: Marks of accounts and contacts, a mobile number, and the shape of an account's name.
ACCOUNT_MARKS, MOBILE, HANDLE = r"tg:|telegram|wechat|wx:|qq:|uid:|@", r"(?:^|[^0-9])1[3-9][0-9]{9}(?:[^0-9]|$)", r"^[A-Za-z][-_A-Za-z0-9]{4,31}$"


def short_hash(json: Column, length: int = 12) -> Column:
    """The first digits of the SHA-256 of a JSON text without spaces, its keys in order."""
    return F.substring(F.sha2(json, 256), 1, length)


def mask_or_hash(value: Column) -> Column:
    """A value fit for prompts and cards: hash:... of what holds personal data or looks like an account or contact, else the value.

    White space around it goes; null and blank values are empty.
    """
    text = F.trim(F.coalesce(value, F.lit("")))
    listed = F.to_json(F.array(text))
    private = (mask_pii(text) != text) | F.lower(text).rlike(ACCOUNT_MARKS) | text.rlike(MOBILE) | text.rlike(HANDLE)
    return F.when(private, F.concat(F.lit("hash:"), short_hash(F.substring(listed, F.lit(2), F.length(listed) - 2)))).otherwise(text)


def card_id(clue_type: Column, key: Column, risk_category: Column, traces: Column, sources: Column, values: Column) -> Column:
    """card_... of a clue: the same for the same evidence, sources and values in any order; values go in masked or hashed. A null array is an empty one, other nulls stay."""
    whole = lambda xs: F.array_sort(F.filter(F.coalesce(xs.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    fields = {"clue_type": clue_type, "entity_values": F.array_sort(F.transform(whole(values), mask_or_hash)), "evidence_trace_ids": whole(traces), "key": key, "risk_category": risk_category, "source_names": whole(sources)}
    return F.concat(F.lit("card_"), short_hash(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and CJK characters one by one, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[一-鿿]"), F.lit(0))


def contains_term(text: Column, term: str) -> Column:
    """An ASCII term at word boundaries in any case; other terms as substrings."""
    if term.isascii():
        import re

        return text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])")
    return text.contains(term)


def negated(text: Column, term: str, negations: tuple[str, ...], before: int = 12, after: int = 8) -> Column:
    """Whether each place of a term has a negation shortly before or after."""
    parts = F.split(text, term.replace("\\", "\\\\"), -1)
    any_of = "|".join(negations)
    near = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.right(F.element_at(parts, i), F.lit(before)).rlike(any_of) | F.left(F.coalesce(F.try_element_at(parts, i + 1), F.lit("")), F.lit(after)).rlike(any_of),
    )
    return F.when(F.size(parts) > 1, F.forall(near, lambda x: x)).otherwise(False)


def ordered_unique(values: Column) -> Column:
    """The first of each value, case aside, without blanks, in order."""
    bare = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.filter(bare, lambda v, i: F.array_position(F.transform(bare, lambda x: F.lower(x)), F.lower(v)) == i + 1)


def freshness(seen: Column, as_of: Column) -> Column:
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(seen)) / 3600.0
    return F.when(seen.isNull(), 0.5).when(hours <= 48, 1.0).when(hours <= 168, 0.75).when(hours <= 336, 0.5).otherwise(0.25)


def phrase_hours(query: Column) -> Column:
    """Hours meant by "last N hours", "last N days" or "today"."""
    n = F.regexp_extract(F.lower(query), r"last ([0-9]+) (?:hour|day)s?", 1).try_cast("int")
    return F.when(F.lower(query).rlike(r"last [0-9]+ days?"), n * 24).when(F.lower(query).rlike(r"last [0-9]+ hours?"), n).when(F.lower(query).contains("today"), 24)


#: Literal variants and their plain forms, in the order of replacement, then patterns and what they become.
VARIANTS = (
    ("➕", "加"), ("＋", "加"), ("✈️", "飞机"), ("✈", "飞机"), ("🛩️", "飞机"), ("🛩", "飞机"), ("🛰️", "飞机"), ("🛰", "飞机"),
    ("🎵", "音符"), ("🐧", "QQ"), ("🍠", "小红书"), ("纸飞机", "飞机"), ("小飞机", "飞机"),
)
VARIANT_PATTERNS = (
    (r"(加|联系|咨询|客服|对接)\s*[+＋➕]?\s*[vV薇微威围]\b", "$1v"), (r"\bv\s*[xX]\b", "vx"), (r"\bw\s*[xX]\b", "vx"), (r"\bd\s*y\b", "dy"),
    (r"音\s*符", "音符"), (r"纸\s*飞\s*机", "纸飞机"), (r"小\s*飞\s*机", "小飞机"), (r"加\s*[vV薇微威围]", "加v"), (r"进\s*裙", "进群"), (r"拉\s*裙", "拉群"),
)


def normalize_intel(text: Column) -> Column:
    """Variant spellings in their plain forms, for matching; the text is normalised first (records are already `compatible`)."""
    out = normalize_text(text)
    for raw, plain in VARIANTS:
        out = F.replace(out, F.lit(raw), F.lit(plain))
    for pattern, plain in VARIANT_PATTERNS:
        out = F.regexp_replace(out, f"(?iuU){pattern}", plain)
    return F.trim(F.regexp_replace(out, r"[\s\u00A0\u0085]+", " "))


def context_relevance(text: Column, start: Column, stop: Column, cues: tuple[str, ...], reach: int = 24) -> Column:
    """0.5, and more for each cue within `reach` characters of a span (ends exclusive), 1 at most."""
    around = F.lower(F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, stop - F.greatest(start - reach, F.lit(0)) + reach))
    hits = sum((around.contains(c).cast("int") for c in cues), F.lit(0))
    return F.round(F.least(F.lit(1.0), 0.5 + hits * 0.15), 4)


def register_all(spark: SparkSession) -> None:
    """Publish the functions to SQL: the vectorised one, and the expressions as SQL functions of one text."""
    spark.udf.register("char_stats", char_stats)
    spark.udf.register("nfkc_text", composed)
    for name, body in {
        "normalize_text": rf"trim(regexp_replace(regexp_replace(coalesce(x, ''), '{ZERO_WIDTH}', ''), '[\\s\u00a0\u0085]+', ' '))",
        "canonical_text": r"regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '')",
        "domain_of": r"regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(x)), '[.]', '.'), '^hxxp', 'http'), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', '')",
        "hash_pii": "sha2(concat_ws(':', 'clueforge', x), 256)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
