"""Retrieval by index, mined terms, term automata and matching rounds against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from clueforge.functions.terms import matcher
from clueforge.operators import matching as M
from clueforge.operators import mining, policy, retrieval

# --- retrieval

WORDS = "mail phone src shop pay kit tool alpha beta gamma delta".split()


def clue_rows(n, seed):
    rng = random.Random(seed)
    return [
        (f"c{i:04d}", rng.choice(["shared_mail", "shared_tool"]), " ".join(rng.sample(WORDS, 3)), rng.sample(WORDS, 2), [f"src{x}" for x in rng.sample(range(6), rng.randrange(3))], rng.choice(["contact", "credential", "prose", None]), rng.choice([None, 0.1, 0.5, 0.72, 0.9, 1.4]), rng.choice([None, 0.3, 0.62, 0.98]), rng.choice([None, 1_000, 900_000]))
        for i in range(n)
    ]


def plain_retrieve(rows, tokens, limit=50, risks=(), preferred=(), cross_source=False, only_risks=(), only_sources=(), least_quality=None, as_of=None, hours=None):
    out = []
    for id_, kind, key, entities, sources, risk, quality, confidence, seen in rows:
        text = " ".join([kind, key, " ".join(entities), " ".join(sources)]).lower()
        overlap = len(set(tokens) & set(re.findall("[a-z0-9]+", text)))
        if least_quality is not None and (quality or 0) < least_quality or only_risks and not any(r in (risk or "") for r in only_risks) or only_sources and not any(s in " ".join(sources) for s in only_sources):
            continue
        stale = hours is not None and seen is not None and as_of - seen > hours * 3600
        if stale and (hours <= 24 or not overlap):
            continue
        score = 0.12 * min(overlap, 6) + 0.1 * min(quality or 0, 1) + 0.08 * min(confidence or 0, 1)
        score += 0.35 * any(r in (risk or "") for r in risks) + 0.15 * any(p in " ".join(sources) for p in preferred) + 0.2 * (cross_source and len(set(sources)) >= 2)
        out.append((-round(score, 6), -(quality if quality is not None else -1), -(confidence if confidence is not None else -1), id_, overlap, stale))
    out.sort()
    best = [o for o in out if o[0] < 0][:limit] or out[: min(limit, 10)]
    return [(o[3], o[4], o[5]) for o in best]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = clue_rows(400, 1)
    schema = "id string, clue_type string, key string, entities array<string>, sources array<string>, risk_category string, quality double, confidence double, seen long"
    return rows, retrieval.clue_index(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("options", [
    {}, {"limit": 5}, {"risks": ("contact",), "cross_source": True, "limit": 20}, {"preferred": ("src1", "src4"), "least_quality": 0.4}, {"only_risks": ("cred",), "only_sources": ("src2",)},
    {"as_of": 1_000_000, "hours": 24}, {"as_of": 1_000_000, "hours": 48, "limit": 400}, {"only_risks": ("nothing",)},
])
def test_retrieve_equals_the_full_scan(indexed, options):
    rows, index = indexed
    for query in (["mail", "shop", "kit"], ["zeta"], []):
        found = retrieval.retrieve(index, query, **options).orderBy("place").collect()
        assert [(r.id, r.overlap, r.stale) for r in found] == plain_retrieve(rows, query, **options)


def test_fallback_and_empty_index(spark, indexed):
    rows, _ = indexed
    schema = "id string, clue_type string, key string, entities array<string>, sources array<string>, risk_category string, quality double, confidence double, seen long"
    bare = [(*r[:6], None, None, None) for r in rows[:30]]
    found = retrieval.retrieve(retrieval.clue_index(spark.createDataFrame(bare, schema)), ["zeta"]).orderBy("place").collect()
    assert [r.id for r in found] == [r[0] for r in bare[:10]] and {r.score for r in found} == {0.0}
    assert retrieval.retrieve(retrieval.clue_index(spark.createDataFrame([], schema)), ["mail"]).count() == 0


def test_best_bands_are_enough(spark, monkeypatch):
    """Unread bands hold nothing that could win, and they are not read."""
    schema = "id string, clue_type string, key string, entities array<string>, sources array<string>, risk_category string, quality double, confidence double, seen long"
    rows = [(f"c{i:04d}", "shared_mail", "mail kit", [], [], "x", 1.0 if i < 40 else 0.1, 0.9 if i < 40 else 0.0, None) for i in range(300)]
    index = retrieval.clue_index(spark.createDataFrame(rows, schema))
    reads = []
    kept = retrieval.Index.postings
    monkeypatch.setattr(retrieval.Index, "postings", lambda self, terms, bands: (reads.append(list(bands)), kept(self, terms, reads[-1]))[1])
    monkeypatch.setattr(retrieval, "FIRST", 1)
    found = retrieval.retrieve(index, [], 30)
    assert len(index.tops) == 2 and reads == [[index.tops[0][0]]] and found.count() == 30
    plan = kept(index, ["mail"], [index.tops[0][0]])._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "band#" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")] and "token" in scan[scan.index("PushedFilters") : scan.index("ReadSchema")]


def test_nearest_words(spark):
    from clueforge.functions import text as T

    docs = spark.createDataFrame([(1, "a b b"), (2, "b"), (3, ""), (4, None), (5, "b c c c")], "id long, text string")
    index = retrieval.word_index(docs, T.tokens(F.col("text")))
    assert [(r.id, r.score) for r in retrieval.nearest(index, {"b": 1.0, "zz": 9.0}, 2).collect()] == [(2, 1.0), (1, round(2 / 5**0.5, 6))]


# --- mined terms


@pytest.mark.parametrize("known", [(), ("黑话",)])
def test_mined_terms_of_cjk_runs(spark, known):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["黑话暗号", "车队", "引流", "x", "1", " "]) for _ in range(30)) for _ in range(40)] + [None, "", "abc", "独"]
    run, least, most = "[一-鿿]{2,12}", 4, 25
    counts, where = collections.Counter(), collections.defaultdict(list)
    for i, t in enumerate(texts):
        for r in re.findall(run, t or ""):
            for n in (2, 3, 4):
                for a in range(len(r) - n + 1):
                    counts[r[a : a + n]] += 1
                    if i not in where[r[a : a + n]]:
                        where[r[a : a + n]].append(i)
    want = sorted((-c, t) for t, c in counts.items() if c >= least and t not in ("车队",) and not any(k in t for k in known))[:most]
    found = mining.mined_terms(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), run, least=least, most=most, known=known, stop=("车队",)).collect()
    assert sorted((-r["count"], r.term) for r in found) == want
    for r in found:
        assert r.document_count == len(where[r.term]) and r.sample_ids == where[r.term][:10]
        assert len(r.contexts) == min(3, len(where[r.term])) and all(r.term in c for c in r.contexts)


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([(1, None), (2, "ab")], "id long, text string")
    assert mining.mined_terms(rows, "[一-鿿]{2,12}").collect() == []


# --- terms


def plain_terms(text, terms):
    low, out = (text or "").lower(), []
    for t in dict.fromkeys(x.strip().lower() for x in terms if x and x.strip()):
        if re.fullmatch(r"[a-z0-9_ +.@:/-]+", t):
            if re.search(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])", low):
                out.append(t)
        elif t in low:
            out.append(t)
    return out


def test_terms_in_one_pass(spark):
    rng = random.Random(2)
    terms = ["a", "ab", "b a", "群控", "控", "usdt", "us", "", None, "A", *("".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(2_000))]
    texts = [None, "", "a", "群控ab", "USDT us", *("".join(rng.choice("abcAB 控_") for _ in range(60)) for _ in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.withColumn("hits", matcher(spark, terms)(F.col("text"))).collect():
        assert r.hits == plain_terms(r.text, terms)
    assert df.select(matcher(spark, [])(F.col("text")).alias("h")).where("size(h) > 0").count() == 0


def test_relevance_and_playbooks(spark):
    df = spark.createDataFrame([(1, "buy tokens"), (2, "token sale"), (3, "token license"), (4, "crowd task"), (5, "crowd task brush"), (6, ""), (7, None), (8, "legal text token")], "id long, text string")
    themes = {"crowd": ("crowd",), "law": ("legal",)}
    found = {r.id: r for r in policy.relevance(df, ("token",), ("license",), themes, ("law",), ("crowd", ("brush",))).collect()}
    assert [i for i, r in found.items() if r.relevant] == [2, 5]
    assert (found[4].matched, found[4].matched_themes, found[5].matched_themes, found[8].excluded_themes, found[3].excluded) == ([], [], ["crowd"], ["law"], ["license"])
    assert [r.id for r in policy.relevance(df).where("relevant").collect()] == [1, 2, 3, 4, 5, 8]
    clues = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z")], "clue_id string, risk_category string")
    evidence = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2), ("c", 2), ("d", 4), ("e", 4)], "clue_id string, trace_id long")
    books = policy.playbooks(clues, evidence, df.withColumnRenamed("id", "trace_id"), {"asset": ("token", "sale"), "law": ("license",), "job": ("task",)}).collect()
    assert [(b.risk_category, b.clue_count, b.evidence_count, b.elements, b.confidence) for b in books] == [("x", 2, 2, {"asset": ["sale", "token"], "law": ["license"]}, 0.8)]


# --- matching


def plain_greedy(pairs):
    best = {}
    for a, b, s in pairs:
        best[a, b] = max(s, best.get((a, b), s))
    out, used = [], set()
    for a in sorted({a for a, _ in best}):
        free = sorted((-s, b) for (x, b), s in best.items() if x == a and b not in used)
        if free:
            used.add(free[0][1])
            out.append((a, free[0][1], -free[0][0]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"e{rng.randrange(12):02d}", f"a{rng.randrange(10):02d}", rng.randrange(5, 5 + 2 * seed + 1)) for _ in range(60)] if seed else []
    found = M.greedy_matches(spark.createDataFrame(pairs, "left string, right string, score long"))
    assert sorted((r.left, r.right, r.score) for r in found.collect()) == plain_greedy(pairs)


def plain_score(e, a):
    norm = lambda v: (v or "").strip().lower()
    if norm(e[1]) != norm(a[1]):
        return 0, 0
    ek, ak = norm(e[2]), norm(a[2])
    key = bool(ek and ak and (ek in ak or ak in ek))
    ents = lambda x: {norm(v) for v in x or [] if norm(v)}
    ent, shared = bool(ents(e[4]) & ents(a[4])), len(ents(e[5]) & ents(a[5]))
    score = 2 + 4 * key + 2 * bool(norm(e[3]) and norm(e[3]) == norm(a[3])) + 3 * ent + (2 + shared if shared else 0)
    if ek and not key and not ent:
        return 0, 0
    if not ek and not ents(e[4]) and shared:
        score += 2
    return (score if score >= 5 else 0), shared


def test_clue_scores(spark):
    rng = random.Random(9)
    def row(i, side):
        return (f"{side}{i}", rng.choice(["k1", "K1 ", "k2"]), rng.choice([None, "", "ab", "abc", "xabcx", "b", "zz"]), rng.choice(["r", "R", None]), rng.choice([None, [], ["v1"], ["V1 ", "v2", ""]]), rng.choice([None, ["1"], ["1", "2", "3"], ["9"]]))
    schema = "id string, clue_type string, key string, risk_category string, entities array<string>, evidence array<string>"
    left, right = [row(i, "e") for i in range(25)], [row(i, "a") for i in range(25)]
    found = {(r.left, r.right): (r.score, r.shared) for r in M.clue_scores(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert found == {(e[0], a[0]): plain_score(e, a) for e in left for a in right if plain_score(e, a)[0]}


def test_mined_terms_shuffle_counts_not_records(spark, monkeypatch):
    from clueforge.operators import mining

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60))) for i in range(3_000)]
    records, before = spark.createDataFrame(rows, "id long, text string"), shuffled()
    got = {r.term: (r["count"], r.document_count, list(r.sample_ids)) for r in mining.mined_terms(records, "[a-z]+", most=20).collect()}
    assert shuffled() - before < 1_000_000
    monkeypatch.setattr(mining, "HELD", 500)  # counts are merged and handed on all the time
    assert got == {r.term: (r["count"], r.document_count, list(r.sample_ids)) for r in mining.mined_terms(records, "[a-z]+", most=20).collect()}
    term = max(got)
    starts = lambda t: sum(t.startswith(term, i) for i in range(len(t)))
    assert got[term] == (sum(starts(t) for _, t in rows), sum(term in t for _, t in rows), [i for i, t in rows if term in t][:10])


def test_counter_of_more_characters_than_numbers():
    import pyarrow as pa

    wide = "".join(chr(c) for c in range(0x10000, 0x20100))
    texts = [wide, "ab\x00abc", wide[:40_000], wide[40_000:] + "ab"]
    want = {}
    for text in texts:
        for n in (2, 3):
            grams = [text[i : i + n] for i in range(len(text) - n + 1) if "\x00" not in text[i : i + n]]
            for g in grams:
                want[g] = (want.get(g, (0, 0))[0] + 1, want.get(g, (0, 0))[1])
            for g in set(grams):
                want[g] = (want[g][0], want[g][1] + 1)
    got = {}
    for batch in mining._counter((2, 3))(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["runs"])])):
        for g, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            got[g] = (got.get(g, (0, 0))[0] + c, got.get(g, (0, 0))[1] + d)
    assert got == want
