"""Secret and personal-data scans against brute force with Python's re."""

import hashlib
import math
import random
import re

from clueforge.llm import pii_scan, secret_scan
from clueforge.llm.queries import op4_secret_scan, op10_pii_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def secrets(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text) if len(m[0]) >= 32]


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, f"card:{m.start()}:{m.end()}") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))]
    return out + [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def texts(seed, bits, n=1500):
    r = random.Random(seed)
    out = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(n)]
    return [*out, None, "", "x" * 30_000, "7" * 30_000, "1.2.3.4" * 2_000, "a@b.c_" * 1_000, out[0], out[0]]


def digest(found):
    return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()


def test_secrets_match_brute_force(spark):
    bits = ["password", "Passwd", "token", "apikey", "API_KEY", "secret", "=", ":", ' "', "'", " ", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "Zz9+/", "ſecret", "K"]
    values = texts(1, bits)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(values)], "doc_id long, text string, n_hex int, spans string")
    model = secret_scan.train(secret_scan.random_samples(docs).unionByName(secret_scan.ordinary_samples(docs)))
    got = {r.doc_id: r for r in secret_scan.scan(docs, model).collect()}
    assert len(got) == len(values)
    for i, text in enumerate(values):
        want = secrets(text or "")
        assert got[i].base_sha256 == digest(want), text
        kinds = [x[1] for x in want]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds.count(0), kinds.count(1), kinds.count(2))
        assert {x[2] for x in want} <= set(got[i].spans.split(","))


def test_personal_data_matches_brute_force(spark):
    bits = ["a", "b@", "c.d", "_", "%", "@", ".", "-", " ", "1", "22", "255", "256.1", "10.0.0.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "(", ")", "é", "😀", "\n", "x.y@z-w.org"]
    values = texts(2, bits)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(values)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in pii_scan.scan(docs, pii_scan.train(spark)).collect()}
    for i, text in enumerate(values):
        want = personal(text or "")
        assert got[i].base_sha256 == digest(want), text
        kinds = [x[1] for x in want]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(kinds.count(k) for k in range(4))
        assert {x[2] for x in want} <= set(got[i].spans.split(","))


def test_models_add_spans_and_leave_prose(spark):
    docs = spark.createDataFrame(
        [(1, "the key is k9Qz7TtP0xLmB4vWcR2n okay"), (2, "an ordinary sentence about configuration_settings_loader here"), (3, "write to mail anna.kov (at) mitol (dot) com today"), (4, "version 123.456.7890 was built")],
        "doc_id long, text string",
    )
    words = "an ordinary sentence about configuration_settings_loader here write to mail get_user_by_name today version was built".split()
    ordinary = spark.createDataFrame([(w, 0) for w in words * 50], "value string, label int")
    model = secret_scan.train(secret_scan.random_samples(docs).unionByName(ordinary))
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs, model).collect()}
    assert found[1] == "random:11:31" and found[2] == ""
    boosted = pii_scan.train(spark)
    pii = {r.doc_id: r for r in pii_scan.scan(docs, boosted, with_redacted=True).collect()}
    assert pii[3].spans == "obfuscated_email:14:43" and pii[3].redacted == "write to mail [obfuscated_email] today"
    assert pii[4].spans == ""


#: Words of identifiers that the model has not learnt its own identifiers from.
UNSEEN = (
    "apple river mountain quick fox bridge orange winter summer forest garden planet rocket dragon silver bottle kitchen teacher student doctor lawyer music guitar piano hockey tennis airport "
    "luggage passport weather thunder rainfall quantum physics chemistry fireplace blanket pillow mattress wallet jacket trousers compass lantern"
).split()


def test_random_strings_are_found_and_identifiers_are_not(spark):
    assert not {*UNSEEN} & {*secret_scan.NAME_WORDS}
    r = random.Random(9)
    shapes = {
        "camel": lambda w: "".join(x.title() for x in w), "lower_camel": lambda w: w[0] + "".join(x.title() for x in w[1:]), "snake": "_".join, "upper": lambda w: "_".join(w).upper(),
        "kebab": "-".join, "path": "/".join, "numbered": lambda w: "_".join(w) + f"_{r.randrange(1000)}", "dated": lambda w: "-".join(w) + f"-20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}",
    }
    lower, upper, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"mixed": (lower + upper + number, 20), "base64": (lower + upper + number + "+/", 40), "lower": (lower + number, 32), "upper_digits": (upper + number, 24), "short_hex": ("abcdef" + number, 24)}
    rows = [(k, shape([r.choice(UNSEEN) for _ in range(4)])) for k, shape in shapes.items() for _ in range(400)]
    rows += [(k, "".join(r.choice(chars) for _ in range(n))) for k, (chars, n) in kinds.items() for _ in range(400)]
    docs = spark.createDataFrame([(i, f"x = {v} ;", k) for i, (k, v) in enumerate(rows)], "doc_id long, text string, kind string")
    prose = spark.createDataFrame([(7, "an ordinary sentence of words about the weather in the garden and the river")] * 40 + [(None, None), (7, "")], "doc_id long, text string")
    model = secret_scan.fit(prose)
    found = {x.kind: x.share for x in secret_scan.scan(docs, model.table, least_each=model.least_each).join(docs, "doc_id").selectExpr("kind", "least(n_random, 1) AS hit").groupBy("kind").agg({"hit": "avg"}).toDF("kind", "share").collect()}
    assert max(found[k] for k in shapes) < 0.01, found
    assert min(found[k] for k in kinds) >= 0.9, found


def test_ratio_matches_brute_force(spark):
    from pyspark.sql import functions as F

    samples = [("abcab", 1), ("aaab", 0), ("ba", 0), ("ba", 0), ("", 1), (None, 0), ("aéb", 0), ("b", 1)]
    table = secret_scan.train(spark.createDataFrame(samples, "value string, label int"))
    counted = secret_scan.train(spark.createDataFrame([("abcab", 1, 1), ("aaab", 0, 1), ("ba", 0, 2), ("aéb", 0, 1)], "value string, label int, n long"))
    assert table == counted
    seen = {0: ["aa", "aa", "ab", "ba", "ba", "ab"], 1: ["ab", "bc", "ca", "ab"]}

    def log(label, a, b):
        alone = (sum(p[1] == b for p in seen[label]) + 0.5) / (len(seen[label]) + 33)
        return math.log((seen[label].count(a + b) + 33 * alone) / (sum(p[0] == a for p in seen[label]) + 33))

    tokens = ["abcabba", "a", "zz/9", "aaaa", ""]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.ratio(F.col("t"), F.array(*map(F.lit, table))).alias("r")).collect()
    for row in rows:
        want = sum(log(1, a, b) - log(0, a, b) for a, b in zip(row.t, row.t[1:], strict=False))
        assert abs(row.r - want) < 1e-4, row


def test_copies_under_other_ids_are_sampled_one_by_one(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "'common words of one text' AS text")
    taken = secret_scan.ordinary_samples(docs, rows=300).count() / 4
    assert 200 < taken < 400


def test_tokens_are_counted_over_all_rows(spark, monkeypatch):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "concat('common words ', if(id % 2000 = 7, 'zzqqzzqqxxjj', 'again')) AS text")
    seen = {}
    trained = secret_scan.train

    def kept(samples, *args, **kwargs):
        seen.update({r.value: r.n for r in samples.where("label = 0").groupBy("value").agg({"n": "max"}).toDF("value", "n").collect()})
        return trained(samples, *args, **kwargs)

    monkeypatch.setattr(secret_scan, "train", kept)
    monkeypatch.setattr(secret_scan, "HELD_OUT", 1_000_003)
    model = secret_scan.fit(docs)
    assert (seen["common"], seen["words"], seen["again"], seen["zzqqzzqqxxjj"]) == (6_000, 6_000, 5_997, 3)
    # So many copies of a corpus give the same model.
    few = docs.where("doc_id < 2000")
    assert secret_scan.fit(few.unionByName(few).unionByName(few)).table == secret_scan.fit(few.unionByName(few)).table == model.table


def test_threshold_is_exact_on_its_steps(spark):
    r = random.Random(5)
    rows = [(r.randrange(-500, 900), r.randrange(1, 50)) for _ in range(4_000)]
    least = secret_scan.bound(spark.createDataFrame(rows, "step long, n long"))
    total, over = sum(n for _, n in rows), lambda step: sum(n for s, n in rows if s > step)
    step = round((least - 1e-6) * secret_scan.STEPS)
    assert over(step) <= secret_scan.MOST_REPORTED * total < over(step - 1)
    assert secret_scan.bound(spark.createDataFrame([], "step long, n long")) == 0.0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    learnt = secret_scan.fit(docs)
    assert secret_scan.scan(docs, learnt.table, least_each=learnt.least_each).count() == 0
    model = secret_scan.train(secret_scan.random_samples(docs).unionByName(secret_scan.ordinary_samples(docs)))
    assert secret_scan.scan(docs, model).count() == 0
    assert pii_scan.scan(docs, pii_scan.train(spark)).count() == 0


def test_queries_cover_all_documents(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert op4_secret_scan(spark, sf).count() == n
    assert op10_pii_scan(spark, sf).count() == n


def test_many_matches_and_long_runs_take_linear_time(spark):
    import time

    many = "token: k9Qz7TtP0xLm, mail a.b@c.de or 10.0.0.1; call (555) 123-4567\n" * 4_000
    docs = spark.createDataFrame([(1, many), (2, "x" * 1_000_000), (3, "+1 (" * 100_000)], "doc_id long, text string")
    model = secret_scan.train(secret_scan.random_samples(docs).unionByName(secret_scan.ordinary_samples(docs)))
    boosted = pii_scan.train(spark)
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.scan(docs, model).collect()}
    hidden = {r.doc_id: r.text for r in secret_scan.redact(docs, model).collect()}
    pii = {r.doc_id: r for r in pii_scan.scan(docs, boosted, with_redacted=True).collect()}
    assert time.time() - began < 60
    assert got[1].n_assign == 4_000 and hidden[1] == many.replace("token: k9Qz7TtP0xLm", "[assign]") and hidden[2] == "x" * 1_000_000
    assert (pii[1].n_email, pii[1].n_ip) == (4_000, 4_000) and pii[1].base_sha256 == digest(personal(many))
    assert pii[2].redacted == "x" * 1_000_000


def test_overlaps_and_redaction_match_brute_force(spark):
    from pyspark.sql import functions as F

    from clueforge.llm._spans import SPAN, apart, redacted

    r = random.Random(4)
    rows = []
    for i in range(300):
        make = lambda rank: sorted((s, rank, s + r.randint(1, 6), f"k{rank}", "", "") for s in r.sample(range(60), r.randint(0, 12)))  # noqa: E731, B023
        rows.append((i, "".join(r.choice("ab é😀") for _ in range(70)), make(1), make(0)))
    docs = spark.createDataFrame(rows, f"i int, text string, found array<{SPAN}>, known array<{SPAN}>")
    for row in docs.select("*", apart(F.col("found"), F.col("known")).alias("left"), redacted(F.col("text"), F.col("found")).alias("cut")).collect():
        want = [x for x in row.found if not any(x.start < k.stop and k.start < x.stop for k in row.known)]
        assert row.left == want
        out, at = "", 0
        for x in sorted(row.found):
            if x.start >= at:
                out += row.text[at : x.start] + f"[{x.kind}]"
            at = max(at, x.stop)
        assert row.cut == out + row.text[at:]
