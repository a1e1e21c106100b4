"""Record, graph and relational operators on hand-made rows."""

from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.operators import graph as G
from clueforge.operators import matching as M
from clueforge.operators import records as R
from clueforge.operators import relational as O
from clueforge.rules import FIXTURE
from clueforge.sources import parsing as P


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")


def test_drop_reasons(spark):
    rows = docs(spark, (None, "a"), ("  ​ ", "a"), ("!!! ???", "a"), ("aaaaaaaaaaaaaaaa", "a"), ("MIT license text for you", None), ("plain words about nothing at all", ""), ("no", "a"))
    got = {r.trace_id: r for r in R.clean(rows, FIXTURE).collect()}
    assert [got[i].drop_reason for i in range(7)] == ["empty_text", "empty_text", "blank_or_garbled", "low_information_entropy", "defensive_context_noise", None, "low_signal_short_text"]
    assert got[4].source_name == "unknown" and got[5].source_name == "unknown"


def test_duplicates_take_the_first_record(spark):
    df = R.duplicate_of(R.clean(docs(spark, ("Same text here", "a"), ("same  TEXT, here!", "b"), ("other words", "a")), FIXTURE))
    assert {r.trace_id: r.duplicate_of for r in df.collect()} == {0: None, 1: 0, 2: None}


def test_polarity_and_negation(spark):
    df = R.polarity(R.clean(docs(spark, ("send the password to a@mail.x +1 (555) 123-4567", "a"), ("not password here", "a"), ("copyright notice", "a"), ("nothing", "a")), FIXTURE), FIXTURE)
    assert [r.polarity for r in df.orderBy("trace_id").collect()] == ["solicitation", "negated", "defensive", "neutral"]


def test_normalisers_are_idempotent(spark):
    df = docs(spark, ("A​  b\tc", "x"), ("Ünï  côdé", "x"), ("ﬁ ①", "x"))
    once = T.nfkc(df.select("doc_id", T.normalize_text(F.col("text")).alias("t")), "t")
    twice = T.nfkc(once.select("doc_id", T.normalize_text(F.col("t")).alias("t")), "t")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.doc_id: r.t for r in once.collect()}[2] == "fi 1"


def test_records_are_compatibility_normalised(spark):
    import unicodedata

    texts = ["ｐａｓｓｗｏｒｄ： ａ＠ｍａｉｌ．ｘ", "ﬁle №①", "e\u0301te\u0301", "Ünï côdé", "plain", "", None, "\u200bａ\u3000 ｂ\u00a0c", "½ ™ ℃ …", "한", "a\n½"]
    got = {r.trace_id: r.clean_text for r in R.records(docs(spark, *[(t, "a") for t in texts])).collect()}
    for i, text in enumerate(texts):
        plain = unicodedata.normalize("NFKC", text or "").replace("\u200b", "")
        assert got[i] == " ".join(plain.split()), text
    hits = R.clean(docs(spark, ("ｐａｓｓｗｏｒｄ", "a"), ("password", "a")), FIXTURE).collect()
    assert hits[0].hit_credential == hits[1].hit_credential > 0 and hits[0].dedup_group == hits[1].dedup_group


def test_masked_or_hashed_values_and_cards(spark):
    import hashlib
    import json

    short = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    private = ["a.b@mail.example.com", "10.0.0.1", "QQ: 1", "uid:7 \"x\"", "13812345678", "call 13812345678!", "some_handle", "Telegram é\\"]
    plain = ["two words", "1abc", "abcd", "x" * 33, "213812345678", "é", "", "   ", None]
    values = spark.createDataFrame([(i, v) for i, v in enumerate(private + plain)], "i int, v string")
    for row in values.select("i", "v", T.mask_or_hash(F.col("v")).alias("out")).collect():
        assert row.out == ("hash:" + short(row.v) if row.i < len(private) else (row.v or "").strip()), row
    rows = spark.createDataFrame([("t", None, "c", ["2", "1"], ["s"], ["two words", "some_handle"]), ("t", None, "c", ["1", "2", None], ["s"], ["some_handle", "two words"]), ("t", "k", "c", None, [], [])], "a string, b string, c string, d array<string>, e array<string>, f array<string>")
    cards = [r[0] for r in rows.select(T.card_id(*[F.col(x) for x in "abcdef"])).collect()]
    want = {"clue_type": "t", "key": None, "risk_category": "c", "evidence_trace_ids": ["1", "2"], "source_names": ["s"], "entity_values": sorted(["hash:" + short("some_handle"), "two words"])}
    assert cards[0] == cards[1] == "card_" + short(want)
    assert cards[2] == "card_" + short(want | {"key": "k", "evidence_trace_ids": [], "source_names": [], "entity_values": []})


def test_shared_clues_do_not_depend_on_order_or_partitions(spark):
    rows = [(f"write to a{i % 3}@mail.example.com now", f"s{i % 4}") for i in range(24)]

    def clues(df):
        entities = G.extract(R.records(df))
        classes = R.classify_fast(R.clean(df, FIXTURE), FIXTURE).select("trace_id", "risk_category", "confidence")
        return sorted(map(str, G.promote(G.quality(G.shared_clues(entities, classes), F.lit(0.5)), FIXTURE).collect()))

    df = docs(spark, *rows)
    assert clues(df) == clues(df.repartition(7)) == clues(df.orderBy(F.desc("doc_id")).coalesce(1))
    assert any("contact_cross_source" in x for x in clues(df))


def test_neighborhood(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "entity_id string")
    assert {r.entity_id: r.hops for r in G.neighborhood(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_cooccurrence_keeps_every_pair_of_large_records(spark):
    rows = [(1, f"e{i:04d}") for i in range(201)] + [(2, f"e{i:04d}") for i in range(64)] + [(3, "e0000"), (3, "e0000"), (4, "e0001"), (4, "e0200")]
    got = {(r.src, r.dst): r.n_traces for r in G.cooccurrence(spark.createDataFrame(rows, "trace_id long, entity_id string")).collect()}
    held = {}
    for trace, entity in rows:
        held.setdefault(trace, set()).add(entity)
    want = {}
    for names in held.values():
        for a in names:
            for b in names:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want and len(got) == 201 * 100


def test_similar_pairs_are_those_of_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    texts = []
    for size in (4, 9, 30, 60, 100, 150, 260, 400):
        for _ in range(4):
            base = "".join(r.choice("abcdefghijklmnopqrst") for _ in range(size))
            texts += [base, base[size // 5 :], "z" + base[: size * 7 // 10]]
            for share in (0.02, 0.05, 0.09, 0.15):
                texts.append("".join(r.choice("uvwxyz") if r.random() < share else c for c in base))
    rows = list(enumerate(dict.fromkeys(texts)))
    grams = {t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else {t} for _, t in rows}
    for least in (M.NEAR, M.TEMPLATE):
        want = set()
        for a, s in rows:
            for b, t in rows[a + 1 :]:
                if min(len(s), len(t)) / max(len(s), len(t)) >= 0.6:
                    score = len(grams[s] & grams[t]) / min(len(grams[s]), len(grams[t]))
                    if max(len(s), len(t)) <= 160:
                        score = max(score, SequenceMatcher(None, t, s, autojunk=False).ratio())
                    if round(score, 4) >= least:
                        want.add((a, b))
        got = M.similar_pairs(spark.createDataFrame(rows, "trace_id long, canonical string"), least).collect()
        assert {(x.a, x.b) for x in got} == want and len(got) == len(want)


def test_latest_and_quota(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k long, o long, v string")
    assert sorted((r.k, r.v) for r in O.latest(rows, "k", ["o"]).collect()) == [(1, "y"), (2, None)]
    many = spark.createDataFrame([(i, f"s{i % 2}", "c") for i in range(10)], "id long, s string, c string")
    assert O.quota_sample(many, "s", "c", "id", 3, 4).count() == 4


def test_sources(spark):
    feeds = spark.createDataFrame([(1, '[{"text": "a"}, {"body": "b"}]'), (2, '{"items": [{"title": "c"}]}'), (3, '{"x": 1}')], "id long, body string")
    assert sorted((r.id, r.t) for r in P.json_rows(feeds, "body").select("id", P.row_text(F.col("row")).alias("t")).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, '{"x": 1}')]
    page = spark.createDataFrame([(1, "<title>T</title><p>a<script>x</script> b"), (2, None)], "page_id long, html string")
    assert {r.page_id: (r.title, r.text) for r in P.snapshots(page).collect()} == {1: ("T", "a b"), 2: ("", "")}
    kinds = spark.createDataFrame([("<html>",), ("[1]",), ('{"a":1}\n{"a":2}',), ("a,b\n1,2",), ("plain",)], "b string")
    assert [r[0] for r in kinds.select(P.sniff(F.col("b"), F.lit(None).cast("string"))).collect()] == ["html", "json", "jsonl", "csv", "txt"]
