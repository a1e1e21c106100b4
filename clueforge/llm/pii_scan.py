"""Personal data: candidate generators and gradient-boosted trees (operator 10).

DataFrame functions only. Base patterns with their checks are always reported.
Besides, generators of high recall propose spans that may overlap; each gets
features of its format and its context, boosted trees turn them into a score, a
calibrated probability and its kind's threshold decide. The trees are trained on
the driver from a generated, labelled and bounded sample whose features come from
the same column expressions, and compiled to one expression.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.llm._spans import SPAN, apart, bound, digits, joined, luhn, redacted, scan as walk, spans

#: The base patterns. Possessive forms and look-behinds only keep long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates, by kind.
GENERATORS = {
    "obfuscated_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]{1,64}){1,8}",
    "local_phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20.-]?[0-9]){6,18}(?![0-9A-Za-z])",
}
KINDS = ("email", "ip", "card", "phone", *GENERATORS)

#: Characters of context (since the candidate of the same kind before), words that speak for each sort of personal data, and words that speak against.
CONTEXT = 24
CUES = (
    r"(?i)\b(e-?mail|mail|correo|courriel)\b",
    r"(?i)\b(phone|tel|mobile|cell|call|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    r"(?i)\b(ssn|social|passport|id|licen[cs]e|ausweis)\b",
    r"(?i)\b(card|visa|account|iban|bank|konto|compte|cuenta)\b",
    r"(?i)\b(version|isbn|order|invoice|ticket|part|serial|build|no|total|page|figure|price|id:? ?#)\b",
)

#: Texts of the training sample, trees, learning rate, and the precision that a kind's threshold is set for.
SAMPLE, TREES, RATE, PRECISION = 1_200, 24, 0.3, 0.95


def features(span: Column) -> Column:
    """Numbers about a span's format and context, in a fixed order."""
    value, number, before = span["value"], digits(span["value"]), span["part"]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda pattern: (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")
    return F.array(
        span["rank"].cast("double"),
        F.length(value).cast("double"),
        F.length(number).cast("double"),
        count("[A-Za-z]"),
        count(r"[\x20.()\[\]-]"),
        flag(luhn(number)),
        count("0"),
        *[flag(before.rlike(cue)) for cue in CUES],
    )


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind."""
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    return [
        spans(text, EMAIL, "email", 0),
        spans(text, IP, "ip", 1, keep=lambda s: F.forall(F.split(s["value"], r"\."), part)),
        spans(text, CARD, "card", 2, keep=lambda s: F.length(digits(s["value"])).between(12, 19) & luhn(digits(s["value"]))),
        spans(text, PHONE, "phone", 3, keep=lambda s: F.length(digits(s["value"])).between(9, 15)),
    ]


def candidates(text: Column) -> Column:
    """The spans of all generators."""
    return F.concat(*[spans(text, p, k, 4 + i, context=CONTEXT) for i, (k, p) in enumerate(GENERATORS.items())])


def labelled_sample(n: int = SAMPLE, seed: int = 5) -> list[tuple[int, str, int, int]]:
    """(id, text, start, stop) of generated texts; start and stop are those of personal data, or -1."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    good = [
        (("mail", "e-mail", "correo", "write to"), lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice([' (at) ', '[at]', ' [at] '])}{word()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net'])}"),
        (("phone", "tel", "call", "mobile", "fax"), lambda: f"{r.choice(['({}) ', '{}-', '{}.', '{} ']).format(d(3))}{d(3)}{r.choice('- .')}{d(4)}"),
        (("ssn", "social", "id"), lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        (("iban", "account", "bank", "konto"), lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"),
        (("card", "visa", "account"), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        (("phone", "call", "mobile"), lambda: f"0{d(3)} {d(3)} {d(3)}"),
    ]
    bad = [
        (("version", "build"), lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        (("isbn", "order", "invoice", "ticket", "serial", "part"), lambda: f"{d(3)}-{d(2)}-{d(4)}" if r.random() < 0.5 else d(r.randint(7, 16))),
        (("total", "price", "page", "figure"), lambda: r.choice([d(8), f"{d(3)} {d(3)} {d(4)}", d(11)])),
        (("the", "of", "and", "with"), lambda: r.choice([d(9), d(16), f"{d(4)}-{d(2)}-{d(2)} {d(4)}", f"{d(2)} {d(3)} {d(3)}"])),
        (("order", "part"), lambda: f"{r.choice(['AB', 'XR'])}{d(2)} {d(4)} {d(4)} {d(4)}"),
    ]
    out = []
    for i in range(n):
        truth = i % 2 == 0
        cues, make = r.choice(good if truth else bad)
        head = " ".join(word() for _ in range(r.randint(0, 6))) + f" {r.choice(cues)}{r.choice([' ', ': ', ' no. ' if not truth else ' is '])}"
        value = make()
        out.append((i, f"{head}{value} {' '.join(word() for _ in range(r.randint(0, 6)))}", len(head) if truth else -1, len(head) + len(value) if truth else -1))
    return out


class Boosted:
    """Trees of depth two under logistic loss, a calibration and a threshold for each kind."""

    def __init__(self) -> None:
        self.trees: list[tuple] = []
        self.start, self.scale, self.shift = 0.0, 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    @staticmethod
    def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-6, None
        base = g.sum() ** 2 / (h.sum() + 1)
        for j in range(x.shape[1]):
            for t in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= t
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - base
                if gain > best:
                    best, found = gain, (j, float(t))
        return found

    def fit(self, x: np.ndarray, y: np.ndarray, kinds: list[str]) -> "Boosted":
        """Two rows of three train, the third calibrates."""
        held = np.arange(len(y)) % 3 == 2
        tx, ty = x[~held], y[~held]
        score = np.zeros(len(ty))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = ty - p, p * (1 - p)
            top = self._stump(tx, g, h)
            if top is None:
                break
            sides = []
            for inside in (tx[:, top[0]] <= top[1], tx[:, top[0]] > top[1]):
                cut = self._stump(tx[inside], g[inside], h[inside]) or (0, float("inf"))
                low = inside & (tx[:, cut[0]] <= cut[1])
                values = [RATE * g[m].sum() / (h[m].sum() + 1) if m.any() else 0.0 for m in (low, inside & ~low)]
                sides.append((*cut, round(float(values[0]), 6), round(float(values[1]), 6)))
            self.trees.append((*top, *sides))
            score = self.raw(tx)
        raw = self.raw(x[held])
        for _ in range(200):  # Platt's scaling by gradient steps
            p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
            self.scale += 0.05 * float(((y[held] - p) * raw).mean())
            self.shift += 0.5 * float((y[held] - p).mean())
        p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
        for kind in sorted(set(kinds)):
            own = np.array([k == kind for k in np.array(kinds)[held]])
            self.thresholds[kind] = 2.0
            for t in sorted(set(np.floor(p[own] * 1e4) / 1e4), reverse=True):
                if y[held][own & (p >= t)].mean() < PRECISION:
                    break
                self.thresholds[kind] = max(0.5, float(t))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for j, t, *sides in self.trees:
            for inside, (k, cut, low, high) in zip((x[:, j] <= t, x[:, j] > t), sides, strict=True):
                out[inside] += np.where(x[inside, k] <= cut, low, high)
        return out

    def probability(self, f: Column) -> Column:
        """The trees as one expression over an array of features."""

        def leaf(side: tuple) -> Column:
            k, cut, low, high = side
            return F.lit(low) if cut == float("inf") else F.when(f[k] <= cut, low).otherwise(high)

        total = F.lit(0.0)
        for j, t, left, right in self.trees:
            total = total + F.when(f[j] <= t, leaf(left)).otherwise(leaf(right))
        return 1 / (1 + F.exp(-(total * self.scale + self.shift)))


def train(spark: SparkSession, sample: list[tuple[int, str, int, int]] | None = None) -> Boosted:
    """Boosted trees from labelled texts (id, text, start, stop of personal data or -1), generated ones if none are given."""
    sample = labelled_sample() if sample is None else sample
    rows = spark.createDataFrame(sample, "id int, text string, start int, stop int")
    found = rows.select("id", "start", "stop", "text", F.explode(candidates(F.col("text"))).alias("c"))
    # A candidate is right if it shares over half of both spans.
    shared = F.greatest(F.least(F.col("c.stop"), F.col("stop")) - F.greatest(F.col("c.start"), F.col("start")), F.lit(0))
    right = (F.col("start") >= 0) & (shared * 2 > F.col("c.stop") - F.col("c.start")) & (shared * 2 > F.col("stop") - F.col("start"))
    got = found.select("id", F.col("c.kind").alias("kind"), F.col("c.start").alias("at"), right.cast("int").alias("y"), features(F.col("c")).alias("f")).collect()
    got.sort(key=lambda r: (r["id"], r["kind"], r["at"]))
    return Boosted().fit(np.array([r["f"] for r in got], float), np.array([r["y"] for r in got], float), [r["kind"] for r in got])


def _best_of_overlaps(likely: Column) -> Column:
    """From scored candidates, those that stay, from left to right: of two that overlap, the more probable, then the longer, then the earlier."""
    kind = f"struct<start:int,span:{SPAN},p:double>"
    end = F.struct(F.lit(2**31 - 1).alias("start"), F.expr(f"cast(null as {SPAN})").alias("span"), F.lit(0.0).alias("p"))
    length = lambda x: x["span"]["stop"] - x["span"]["start"]
    apart_from = lambda held, x: held.isNull() | (x["start"] >= held["span"]["stop"])
    better = lambda held, x: (x["p"] > held["p"]) | ((x["p"] == held["p"]) & (length(x) > length(held)))
    advance = lambda held, x: F.when(apart_from(held, x) | better(held, x), x).otherwise(held)
    emit = lambda held, x: F.when(apart_from(held, x), held["span"])
    stays = walk(F.concat(F.array_sort(likely), F.array(end)), F.expr(f"cast(null as {kind})"), advance, emit, SPAN)
    return F.filter(stays, lambda s: s.isNotNull())


def scan(docs: DataFrame, model: Boosted, doc_id: str = "doc_id", text: str = "text", with_redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_model, n_spans, base_sha256, spans of every row.

    `spans` has the base spans and the model's: candidates over their kind's
    threshold that overlap no base span; where those overlap each other, the more
    probable stays, from left to right (ties: the longer, then the earlier). `redacted`, where asked for, has
    the text with its spans replaced by their kinds. Null texts count as empty:
    no spans, digest of the empty string. Repeated rows are scanned each; other
    columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), *[c.alias(k) for k, c in zip(KINDS, base_spans(body), strict=False)], candidates(body).alias("proposed"))
    limits = F.create_map(*[x for k, t in {**dict.fromkeys(GENERATORS, 2.0), **model.thresholds}.items() for x in (F.lit(k), F.lit(t))])
    known = F.concat(*KINDS[:4])
    found = base.withColumn("known", known).withColumn("free", apart(F.col("proposed"), F.col("known")))
    scored = F.transform("free", lambda c: F.struct(c["start"].alias("start"), c.alias("span"), bound(features(c), model.probability).alias("p")))
    likely = F.filter(scored, lambda x: x["p"] >= F.element_at(limits, x["span"]["kind"]))
    found = found.withColumn("likely", F.when(F.size("free") > 0, likely)).withColumn("added", F.when(F.size("likely") > 0, _best_of_overlaps(F.col("likely"))).otherwise(F.slice("known", 1, 0)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.size("added").cast("long").alias("n_model"),
        (F.size("known") + F.size("added")).cast("long").alias("n_spans"),
        F.sha2(joined(F.col("known")), 256).alias("base_sha256"),
        joined(F.concat("known", "added")).alias("spans"),
        *([redacted(F.col("text"), F.concat("known", "added")).alias("redacted")] if with_redacted else []),
    )
