"""Secret scans: base patterns, and random strings found by two character Markov models (operator 4).

DataFrame functions only. Two models of character pairs are counted, one of
random strings and one of all ordinary tokens of the corpus and of identifiers. Their
log-likelihood ratio, a table of 128 x 128 numbers, becomes a literal of the
scan, and long tokens with a large ratio are reported besides the base spans.
The ratio that a token needs is set on identifiers held out of the counts.
"""

from __future__ import annotations

import math

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.llm._spans import apart, joined, redacted, spans
from clueforge.session import materialise

#: The base patterns, by kind in the order of the kinds, and the least length that a match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8

#: Tokens that the models judge, the least log-likelihood ratio (nats) in all and for each character, by how much both rise for tokens without a digit, and the random strings to learn from.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
LEAST_RATIO, LEAST_PER_CHARACTER, NO_DIGIT, RANDOM_STRINGS = 12.0, 0.6, 1.5, 3_000

#: Labelled identifiers to learn from, the rows of a corpus beside which each counts once (in a larger one it counts more often, so that its share stays), the share of the held-out ones that may be reported, one in how many is held out, and steps of a threshold in a nat.
IDENTIFIERS, ROWS_EACH, MOST_REPORTED, HELD_OUT, STEPS = 12_000, 1_000, 0.002, 4, 1_000

#: Words of which names in programs, files and addresses are made, besides the words of the corpus.
NAME_WORDS = (
    "account action active address admin agent archive array async audit author backup balance base batch billing binary block body branch browser buffer build button cache call category channel check "
    "child class client cloud cluster code collection column command comment commit common component config connection console constant contact container content context control controller copy count create current customer "
    "data database date debug default delete delivery deploy detail device dialog directory display document domain download driver editor element email enable engine entry error event example export factory failure feature "
    "field file filter final find folder format forward frame function gateway generate get global graph group handler hash header height history home hook host image import index info init input insert instance "
    "integer interface internal invoice item job join json key label language last layout length level library limit line link list listener load local location lock log login manager map mask master match "
    "max memory menu merge message metadata method middleware migration min mode model module monitor name network node notification null number object offset open option order output owner package page parameter parent parse "
    "partition patch path payment pending permission pipeline plugin pool port position prefix preview primary print process product profile project property provider proxy public publish query queue range read record recovery region register "
    "release remote remove render replace report request reset resource response result retry role root route row runtime sample save schedule schema scope script search section select send sequence server service session set setting "
    "shipping size sort source stack start state static status step storage store stream string style submit summary support switch sync system table target task template temp test text theme thread time title total trace "
    "transaction transfer tree type update upload url user util validate value variable vector vendor version video view wait warning web widget width window worker wrapper write zone"
).split()


class Scanner(NamedTuple):
    """The log-likelihood ratios of pairs of characters, and the least ratio for each character of a token."""

    table: list[float]
    least_each: float


def random_samples(docs: DataFrame, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled random strings (label 1): hexadecimal, base64 and upper-case digests of the numbers below n."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    value = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 32)).when(F.col("id") % 3 == 1, F.substring(base64, 1, 40)).otherwise(F.substring(F.upper(F.regexp_replace(base64, "[+/=]", "")), 1, 24))
    return docs.sparkSession.range(n).select(value.alias("value"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, text: str = "text", rows: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Labelled ordinary strings (label 0): the tokens, without base matches, of all texts, or of about `rows` whole ones.

    With `rows` a text is taken by the hash of its id and itself, at a rate that
    makes so many of all rows, so that copies under other ids are taken one by
    one; a table with fewer rows is taken whole. `fit` takes all texts.
    """
    some = docs.select(F.col(text).alias("text"))
    if rows is not None:
        rate = min(1.0, rows / max(1, docs.count()))
        some = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key")).where(F.pmod(F.col("key"), F.lit(1 << 30)) < rate * (1 << 30))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    return some.select(F.explode(F.regexp_extract_all(bare, F.lit("[A-Za-z_/+-][A-Za-z0-9_/+-]{3,}"), F.lit(0))).alias("value"), F.lit(0).alias("label"))


def ordinary_identifiers(docs: DataFrame, words: list[str], n: int = IDENTIFIERS) -> DataFrame:
    """Labelled identifiers (label 0) of two to six of the words: snake, kebab, camel and upper case, paths, and some with numbers or dates."""
    known = F.split(F.lit(" ".join(words)), " ")
    draw = lambda i: F.xxhash64(F.lit("identifier"), "id", i)
    size = F.pmod(draw(F.lit(-1)), F.lit(5)).cast("int") + 2
    picked = F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(known, F.pmod(draw(i), F.lit(len(words))).cast("int") + 1))
    number = F.pmod(draw(F.lit(-2)), F.lit(3000)).cast("string")
    date = F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(draw(F.lit(-3)), F.lit(12_000)).cast("int")).cast("string")
    camel = F.array_join(F.transform("words", lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    plain = lambda by: F.array_join("words", by)
    shapes = [
        plain("_"), camel, F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 1 << 20)), plain("-"), F.upper(plain("_")), plain("/"), plain(""),
        F.concat(plain("_"), F.lit("_"), number), F.concat(camel, number), F.concat(plain("-"), F.lit("-"), date), F.concat(F.regexp_replace(date, "-", "/"), F.lit("/"), plain("-")), F.concat(plain("/"), F.lit("/v"), F.substring(number, 1, 1)),
    ]
    return docs.sparkSession.range(n).select("id", picked.alias("words")).select(F.coalesce(*[F.when(F.pmod(F.col("id"), F.lit(len(shapes))) == i, shape) for i, shape in enumerate(shapes)]).alias("value"), F.lit(0).alias("label"))


def frequent_words(tokens: DataFrame, most: int = 2_000) -> list[str]:
    """The commonest words, in lower case, of three to twelve letters of the counted tokens (value, n); at most `most`, ties by spelling."""
    words = tokens.select("n", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where(F.length("word").between(3, 12))
    return [r["word"] for r in words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


def fit(docs: DataFrame, text: str = "text") -> Scanner:
    """The models of random strings and of all ordinary tokens and identifiers, with a threshold set on held-out identifiers.

    Tokens are counted over all rows. Identifiers are made of the corpus's
    frequent words and of NAME_WORDS, and count once for every ROWS_EACH rows; one
    in HELD_OUT, and the corpus's tokens by the same rule, are left out of the
    counts. The ratio for each character is the least (in STEPS) at which at most
    MOST_REPORTED of those that are long enough are reported, and at least
    LEAST_PER_CHARACTER. Empty tables leave the identifiers alone to learn from.
    """
    # Written once, so that the table is read once.
    tokens = materialise(ordinary_samples(docs, text).groupBy("value", "label").agg(F.count("*").alias("n")), "secret_tokens")
    times = max(1, round(docs.count() / ROWS_EACH))
    ordinary = ordinary_identifiers(docs, sorted({*frequent_words(tokens), *NAME_WORDS})).withColumn("n", F.lit(times).cast("long")).unionByName(tokens)
    out = F.pmod(F.xxhash64(F.lit("held out"), "value"), F.lit(HELD_OUT)) == 0
    table = train(random_samples(docs).withColumn("n", F.lit(1).cast("long")).unionByName(ordinary.where(~out)), times=times)
    # Both bounds of a report, as one number: a token is reported where its ratio reaches the need times this.
    judged = ordinary.where(out & F.col("value").rlike(f"^{TOKEN}$") & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(f"{ACCESS}|{HEX}"))
    each = judged.select("n", F.ceil(ratio(F.col("value"), _literal(table)) / F.length("value") / _strict(F.col("value")) * STEPS).alias("step"))
    return Scanner(table, max(LEAST_PER_CHARACTER, bound(each)))


def bound(each: DataFrame) -> float:
    """The least number of nats, in STEPS, that at most MOST_REPORTED of the counted rows (step, n) exceed; 0 without rows.

    Only a count for each step reaches the driver: as many as a pair's ratios have steps.
    """
    counts = sorted(((r["step"], r["n"]) for r in each.groupBy("step").agg(F.sum("n").alias("n")).collect()), reverse=True)
    room = MOST_REPORTED * sum(n for _, n in counts)
    for step, n in counts:
        room -= n
        if room < 0:
            # What has just this step is not reported either.
            return round(step / STEPS + 1e-6, 6)
    return 0.0


def train(samples: DataFrame, smoothing: float = 0.5, times: int = 1) -> list[float]:
    """The log-likelihood ratio of each pair of ASCII characters, from rows of (value, label), or of (value, label, n) for n equal ones.

    A pair's place is 128 * first + second. Null and empty values add nothing. A
    pair that a model has hardly seen has about the probability of its second
    character alone, and that is smoothed. Ordinary strings are smoothed `times`
    as much, so that a corpus of so many copies gives the same model.
    """
    counted = F.col("n") if "n" in samples.columns else F.lit(1)
    chars = samples.select(F.col("label").cast("int").alias("label"), counted.cast("long").alias("n"), F.split(F.regexp_replace("value", r"[^\x20-\x7E]", ""), "").alias("c"))
    pairs = chars.where(F.size("c") > 1).select("label", "n", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = pairs.where(F.length("pair") == 2).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    symbols, smooth = 66, {0: smoothing * times, 1: smoothing}
    total = {(label, a): 0 for label in (0, 1) for a in range(128)}
    into = {(label, b): 0 for label in (0, 1) for b in range(128)}
    seen = {}
    for row in counts:
        a, b = map(ord, row["pair"])
        seen[row["label"], a, b] = row["n"]
        total[row["label"], a] += row["n"]
        into[row["label"], b] += row["n"]
    every = {label: sum(into[label, b] for b in range(128)) for label in (0, 1)}

    def log(label: int, a: int, b: int) -> float:
        weight = smooth[label] * symbols
        alone = (into[label, b] + smooth[label]) / (every[label] + weight)
        return math.log((seen.get((label, a, b), 0) + weight * alone) / (total[label, a] + weight))

    return [round(log(1, a, b) - log(0, a, b), 6) for a in range(128) for b in range(128)]


def ratio(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token under the two models."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.element_at(table, acc["last"] * 128 + c + 1)).otherwise(0.0)).alias("sum")),
        lambda acc: acc["sum"],
    )


def _literal(table: list[float]) -> Column:
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")


def _strict(token: Column) -> Column:
    """By how much a token's needs rise."""
    return F.when(token.rlike("[0-9]"), 1.0).otherwise(NO_DIGIT)


def _found(body: Column, table: list[float], least: float, least_each: float) -> tuple[dict[str, Column], Column]:
    """The base spans by kind, and the tokens that the models judge to be random, as columns of those names and `random`."""
    llr = _literal(table)
    base = {
        "assign": spans(body, ASSIGN, "assign", 0, 2, lambda s: F.length(s["part"]) >= LEAST_ASSIGNED),
        "access": spans(body, ACCESS, "access", 1),
        "hex": spans(body, HEX, "hex", 2),
    }
    judged = spans(body, TOKEN, "random", 3, 0, lambda s: s["value"].rlike("[A-Za-z]") & (ratio(s["value"], llr) >= _strict(s["value"]) * F.greatest(F.lit(least), F.length(s["value"]) * least_each)))
    return {k: c.alias(k) for k, c in base.items()}, judged.alias("random")


def redact(docs: DataFrame, table: list[float], text: str = "text", least: float = LEAST_RATIO, least_each: float = LEAST_PER_CHARACTER) -> DataFrame:
    """All rows and columns, the text with every secret replaced by its kind in brackets.

    Texts without secrets and nulls stay as they are. Columns may have any names
    but those that begin with `_secret`.
    """
    known, free = _found(F.coalesce(F.col(text), F.lit("")), table, least, least_each)
    held = docs.select("*", F.struct(*known.values(), free).alias("_secret"))
    base = F.concat(*[F.col(f"_secret.{k}") for k in known])
    every = F.concat(base, apart(F.col("_secret.random"), base))
    return held.withColumn("_secret", every).select(*[redacted(F.col(text), F.col("_secret")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def scan(docs: DataFrame, table: list[float], doc_id: str = "doc_id", text: str = "text", least: float = LEAST_RATIO, least_each: float = LEAST_PER_CHARACTER) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row.

    `spans` has the base spans and, of kind `random`, the tokens that the models
    judge to be random and that overlap no base span. Null texts count as empty:
    no spans, digest of the empty string. Repeated rows are scanned each; other
    columns are not read.
    """
    known, free = _found(F.coalesce(F.col(text), F.lit("")), table, least, least_each)
    base = docs.select(F.col(doc_id).alias("doc_id"), *known.values(), free)
    known = F.concat(*known)
    base = base.withColumn("free", apart(F.col("random"), known))
    return base.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("free").cast("long").alias("n_random"),
        F.sha2(joined(known), 256).alias("base_sha256"),
        joined(F.concat(known, F.col("free"))).alias("spans"),
    )
