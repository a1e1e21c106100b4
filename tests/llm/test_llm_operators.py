"""The other operators against brute force, round trips, held-out accuracy and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clueforge.llm import bpe_codec, decontaminate, jaccard_join, language_id, lm_scoring, topk_search, warc_derive
from clueforge.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from clueforge.llm.token_counts import count_tokens

ODD = [None, "", " ", "\n\t ", "a", "A b", "a b c", "é", "😀" * 50, "word " * 3_000, "x" * 50_000, "the same text twice over", "the same text twice over"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, 1.0, i) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, score double, n_tokens int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "tab\t\t x", "don't  we'll", "日本語 テキスト", "͸\U00018e00's"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in count_tokens(docs, path).join(docs, "doc_id").collect():
        text = r.text or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert count_tokens(empty, path).count() == 0


def test_bpe_codec(spark, odd, empty):
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=bpe_codec.pre_tokens.__globals__["PATTERN"], mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    for r in bpe_codec.encode_decode(odd, path, with_ids=True).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == lib.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (r.text or "")
    assert bpe_codec.encode_decode(empty, path).count() == 0


def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in language_id.predict(odd, model, {"doc_id": F.col("doc_id")}).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["und"] * 4 and rows[4].lang_pred != "und" and len(rows) == len(ODD)
    untrained = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(odd, untrained, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language_id.predict(empty, model, {"doc_id": F.col("doc_id")}).count() == 0


def brute_language(rows, texts, buckets):
    """(language, score, fit) of each text under naive Bayes of labelled rows, n-gram by n-gram."""
    odd, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 0xFFFFFFFF

    def grams(text):
        codes = [ord(c) for c in text.lower()]
        for order in (1, 2, 3):
            for i in range(len(codes) - order + 1):
                h = order * 0x27D4EB2F & mask
                for k in range(order):
                    h ^= codes[i + k] * odd[k] & mask
                    h = (h ^ h >> 15) * 0x2C1B3C6D & mask
                yield (h ^ h >> 13) & buckets - 1

    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        sizes[lang] += 1
        counts[lang].update(grams(text))
    unit = language_id.UNIT
    logs = lambda lang, b: round(math.log((counts[lang][b] + 1) / (sum(counts[lang].values()) + buckets)) * unit)
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0, None))
            continue
        seen = list(grams(text))
        prior = {x: round(math.log(sizes[x] / sum(sizes.values())) * unit) for x in sizes}
        total = {x: prior[x] + sum(logs(x, b) for b in seen) for x in sizes}
        best = min(total, key=lambda x: (-total[x], x))
        out.append((best, 1 / sum(math.exp((t - total[best]) / unit) for t in total.values()), (total[best] - prior[best]) / unit / len(seen) + math.log(buckets)))
    return out


def test_language_matches_brute_force(spark):
    labelled = [("en", "the cat sat on the mat"), ("en", "a dog and the bone"), ("de", "der Hund und die Katze"), ("de", "ÜBER den Fluß"), ("fr", "le chat est sur la table"), (None, "unlabelled"), ("xx", None)]
    texts = ["the dog", "die Katze", "la table est", "", None, "1234 !?", "é", "日本語のテキスト", "Ω", "the dog", "x" * 3_000]
    model = language_id.train(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(labelled)], "doc_id long, lang string, text string"), buckets=1 << 12)
    docs = spark.createDataFrame([(i, t, "z", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double").repartition(3)
    got = {r.doc_id: r for r in language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()}
    for i, (lang, score, fit) in enumerate(brute_language([x for x in labelled if None not in x], texts, 1 << 12)):
        assert (got[i].lang_pred, got[i].score) == (lang, pytest.approx(score)) and got[i].text == texts[i]
        assert got[i].fit == (None if fit is None else pytest.approx(fit))
    with pytest.raises(ValueError):
        language_id.train(spark.createDataFrame([(i, f"l{i}", "a") for i in range(1000)], "doc_id long, lang string, text string"))


def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def test_language_learns_from_all_rows(spark):
    rows, buckets = 24_000, 1 << 12
    model = language_id.train(spark.range(rows).selectExpr("id AS doc_id", "'ab' AS text", "'xx' AS lang"), buckets=buckets)
    probability = (rows + 1) / (3 * rows + buckets)
    assert np.sum(model["matrix"] == round(math.log(probability) * language_id.UNIT)) == 3


def test_benchmarks_over_a_bound(spark):
    with pytest.raises(ValueError):
        list(decontaminate.item_parts(spark.createDataFrame([("a", "b")], "item_id string, text string"), most=12))
    one = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(100)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)), "k"), (1, " ".join(f"w{i}" for i in range(20, 33)), None), (None, None, "k")], "doc_id long, text string, source string")
    got = decontaminate.decontaminate(docs, decontaminate.item_parts(one, most=20), keep=("source",), with_text=True, with_clean=True).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated, r.source or "") for r in got) == [(0, 0, 0, False, "k"), (13, 13, 1, True, ""), (100, 100, 1, True, "k")]
    assert {r.text for r in got} == {r.text for r in docs.collect()} and not any(r.clean_text for r in got)


def brute_hits(items, text):
    """n_words, n_hit, n_items and items_sha256 of a text."""
    windows = collections.defaultdict(set)
    take = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    for i, (name, body) in enumerate(items):
        words = take(body)
        k = min(13, len(words))
        for j in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[j : j + k])].add((name, None if name else i))
    words = take(text)
    hit, found = [False] * len(words), set()
    for k in {len(w) for w in windows}:
        for j in range(len(words) - k + 1):
            if names := windows.get(tuple(words[j : j + k])):
                found |= names
                hit[j : j + k] = [True] * k
    digest = hashlib.sha256(",".join(sorted(name for name, _ in found if name)).encode()).hexdigest()
    return len(words), sum(hit), len(found), digest


@pytest.mark.parametrize(("short", "most"), [(False, None), (True, None), (False, 200), (True, 100)])
def test_decontaminate(spark, odd, empty, short, most):
    r = np.random.default_rng(5)
    say = lambda n, of: " ".join(f"w{i}" for i in r.integers(0, of, n))
    benchmark = [("i1", " ".join(f"w{i}" for i in range(30))), ("i2", " ".join(f"w{i}" for i in range(10, 25))), ("i3", ""), ("i4", None), (None, "n1 n2 n3 " * 5), (None, "n1 n2 n3 " * 5), (None, None)]
    benchmark += [("i2", "q " * 20)] + [(f"r{i}", say(30, 4)) for i in range(20)] + ([("i5", "w3 W4"), ("i6", "w1")] if short else [])
    rows = [(100, " ".join(f"w{i}" for i in range(5, 40))), (101, "x " * 300 + " ".join(f"W{i}" for i in range(13))), (102, "w3 w4 x w3"), (103, " ".join(f"w{i}" for i in range(12))), (104, "so n1 n2 n3 n1 n2 n3 n1 n2 n3 n1 n2 n3 n1 n2 n3"), (105, "q-q " * 8)]
    rows += [(200 + i, say(40, 4)) for i in range(200)] + [(400 + i, benchmark[-3][1][i : i + 60] + " and " + benchmark[9][1]) for i in range(20)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    table = spark.createDataFrame([(*b, 1) for b in benchmark], "item_id string, text string, n_hit int")
    items = decontaminate.build_items(table) if most is None else list(decontaminate.item_parts(table, most=most))
    if most is not None:
        words = sum(len(brute_words(b[1] or "")) for b in benchmark)
        assert len(items) >= -(-words // most) and all(len(p.words) <= most for p in items)
        docs = docs.repartition(2)
    clashing = docs.withColumn("n_hit", F.lit(1)).withColumn("contaminated", F.lit("x"))
    got = decontaminate.decontaminate(clashing, items, with_clean=True).join(docs, "doc_id").collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (want := brute_hits(benchmark, r.text)), r.text
        assert r.contaminated == (want[1] > 0 and 20 * want[1] >= want[0])
        if not want[1]:
            assert r.clean_text == r.text
    assert decontaminate.decontaminate(empty, items).count() == 0
    none = decontaminate.build_items(spark.createDataFrame([], "item_id string, text string"))
    assert decontaminate.decontaminate(docs, none).where("n_hit > 0").count() == 0


def brute_components(rows, width=3, least=(9, 10)):
    """(n_shingles, component) of each row; rows are linked whatever their ids."""
    sets, part, whole = [], *least
    for _, t in rows:
        w = spaced(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and whole * common >= part * (len(sets[a]) + len(sets[b]) - common):
                parent[find(b)] = find(a)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min(ids[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def families(seed, n, copies, changes):
    r = np.random.default_rng(seed)
    for family in range(n):
        words = [f"v{x}" for x in r.integers(0, 400, int(r.integers(4, 120)))]
        for copy in range(copies):
            own = list(words)
            for _ in range(int(r.integers(0, changes))):
                own[int(r.integers(0, len(own)))] = f"n{int(r.integers(0, 50))}"
            yield 1000 + 100 * family + copy, " ".join(own)


@pytest.mark.parametrize(("block", "one_task", "width", "least"), [(96, 1_000_000, 3, (9, 10)), (4, 0, 3, (9, 10)), (4, 1_000_000, 5, (4, 5))])
def test_jaccard_components(spark, empty, block, one_task, width, least, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ONE_TASK", one_task)
    rows = [*enumerate(ODD), *families(3, 6, 14, 5)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, sid int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width=width, least=least).collect())
    assert got == brute_components(rows, width, least)
    if block == 96:
        assert jaccard_join.jaccard_components(empty).count() == 0


def shuffled(spark):
    """Bytes that this session's shuffles have written so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


@pytest.mark.parametrize(("block", "at_once"), [(96, 90), (4, 1_000_000)])
def test_jaccard_components_deals_out_no_texts(spark, block, at_once, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", at_once)
    monkeypatch.setattr(jaccard_join, "OUTSIDE", 20_000)
    rng, rows = random.Random(7), []
    for family in range(8):
        words = [f"{rng.randrange(10**9):x}" for _ in range(500)]
        for copy in range(40):
            own = list(words)
            for place in rng.sample(range(500), rng.choice((2, 9, 9, 9))):  # of two copies some are linked and some are not
                own[place] = f"{rng.randrange(10**9):x}"
            rows.append((100 * family + copy, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, small = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert shuffled(spark) - before < 3 * sum(len(t) for _, t in rows)
    assert got == brute_components(rows)


def test_near_copies_neither_sort_nor_lose_texts(spark, monkeypatch):
    import corpus_pipeline

    rows = [*families(5, 4, 6, 3), *((5000 + i, t) for i, (_, t) in enumerate(families(5, 4, 2, 3))), (1001, "another row of an id"), (1001, "another row of an id"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "x", "y", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    broadcast = sorted(map(str, corpus_pipeline.near_copies(spark, docs, "").collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 1)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_copies(spark, docs, "")
        assert sorted(map(str, kept.collect())) == broadcast
        plan = kept._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_jaccard_components_without_ids_and_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words, "x", "y", "z", "q", "r"]), " ".join([*words[3:], "x", "y", "z", "q", "r"])
    alone, last = " ".join(f"u{i}" for i in range(40)), " ".join(f"u{i}" for i in range(41))
    rows = [(1, a), (None, b), (3, c), (None, alone), (None, last), (7, None), (None, None), (8, a), (8, alone + " t"), (8, alone + " t"), (9, "k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    want = brute_components(rows)
    assert got == want
    assert got[(3, len(c.split()) - 2, 1)] == 1


def test_lm_scoring(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    words = {d: [*spaced(t), None] for d, t in rows}
    counts = collections.Counter(w for d in words if not held[d] for w in words[d])
    total, distinct = sum(counts.values()), len(counts)
    learn = lm_scoring.F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    model = lm_scoring.train(docs.where(learn))
    got = lm_scoring.score(docs, model, ~learn).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.train_tokens == total and r.n_tokens == len(words[r.doc_id])
        assert r.n_known == sum(counts[w] > 0 for w in words[r.doc_id]) and r.base_score == pytest.approx(want)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm_scoring.score(empty, model, F.lit(False)).count() == 0
    blank = lm_scoring.train(empty)
    assert lm_scoring.score(odd, blank, F.lit(True)).where("n_known > 0").count() == 0


def test_lm_learns_from_all_training_rows(spark):
    texts = ["aa bb cc dd"] * 700 + ["kk ll mm nn oo pp " * 2_000] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = lm_scoring.train(docs)
    probe = spark.createDataFrame([(1, "kk ll mm nn oo pp " * 20)], "doc_id long, text string")
    got = lm_scoring.score(probe, model, F.lit(True)).collect()[0]
    assert got.score / got.n_tokens > -0.2


def brute_lm(text, vocabulary, attention):
    """log10 probability of a text, one position at a time in double precision."""
    import pyarrow as pa

    from clueforge.llm._text import utf8, word_hashes

    place = {int(k): int(u) for k, u in zip(vocabulary.words, vocabulary.word_unit, strict=True)}
    parts = {int(k): int(u) for k, u in zip(vocabulary.parts, vocabulary.part_unit, strict=True)}
    units, total = [], 0.0
    for word in spaced(text):
        raw = word.encode()
        key = int(word_hashes(*utf8(pa.array([word])), lm_scoring.IS_WORD)[0][0])
        cut = [(key, None)] if key in place else [(None, raw[i : i + 5]) for i in range(0, len(raw), 5)]
        for i, (known, piece) in enumerate(cut):
            value = None if known else sum(b << (8 * k) for k, b in enumerate(piece)) | len(piece) << 40 | (i == 0) << 44
            unit = place[known] if known else parts.get(value, lm_scoring.UNKNOWN)
            units.append(unit)
            total += vocabulary.inside[unit] if unit != lm_scoring.UNKNOWN else -math.log10(10) + sum(vocabulary.byte[b] for b in piece)
    units.append(lm_scoring.END)
    cls = [int(vocabulary.cls[u]) for u in units]
    w = {n: getattr(attention, n).astype(float) for n in attention.NAMES}
    d, context = lm_scoring.WIDTH, lm_scoring.CONTEXT
    for at, target in enumerate(cls):
        first = at // (lm_scoring.WINDOW - context) * (lm_scoring.WINDOW - context) - context
        seen = [cls[q - 1] if q > 0 else lm_scoring.BEGIN for q in range(first, at + 1)]
        x = w["embed"][seen] + w["place"][: len(seen)]
        q, k, v = x[-1] @ w["qkv"][:, :d] / math.sqrt(d), x @ w["qkv"][:, d : 2 * d], x @ w["qkv"][:, 2 * d :]
        weight = np.exp(k @ q - (k @ q).max())
        h = x[-1] + (weight / weight.sum()) @ v @ w["out"]
        logits = h @ w["head"] + w["bias"]
        total += (logits[target] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
    return total


def test_lm_score_matches_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm_scoring, "TOGETHER", 7)
    monkeypatch.setattr(lm_scoring, "WORDS", 3_000)
    monkeypatch.setattr(lm_scoring, "PIECES", 2_000)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    model = lm_scoring.train(docs.where(learn))
    probes = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD[:9], "Ünknown wörds zzzqqqxxxyyy and more", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3])], "doc_id long, text string")
    some = probes.union(docs.where("doc_id < 20"))
    for r in lm_scoring.score(some, model, F.lit(True)).collect():
        if r.doc_id < len(ODD[:9]) + 2 or r.n_tokens < 400:
            assert any(r.score == pytest.approx(brute_lm(t, model["vocabulary"], model["attention"]), rel=1e-4) for d, t in some.where(F.col("doc_id") == r.doc_id).collect())


def test_lm_beats_the_base_on_words_it_knows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    model = lm_scoring.train(docs.where(learn))
    counts = collections.Counter(w for r in docs.where(learn).collect() for w in spaced(r.text))
    known = [(r.doc_id, " ".join(w for w in spaced(r.text) if counts[w] > 1)) for r in docs.where(~learn).collect()]
    held = lm_scoring.score(spark.createDataFrame(known, "doc_id long, text string"), model, F.lit(True)).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).collect()[0]
    assert held[0] > held[1] + 0.1


def test_attention_gradients_and_causality():
    r = np.random.default_rng(0)
    model = lm_scoring.Attention(np.ones(lm_scoring.CLASSES))
    ids = r.integers(3, 20, 200).astype(np.int32)
    inputs, targets, _ = lm_scoring.windows(ids, np.array([0, 70, 70, 200]))
    assert (targets >= 0).sum() == 200
    gradients, n = model.gradients(inputs, targets), (targets >= 0).sum()
    for name in model.NAMES:
        value = getattr(model, name)
        at = np.unravel_index(np.abs(gradients[name]).argmax(), value.shape)
        old, losses = value[at], []
        for step in (1e-2, -1e-2):
            value[at] = old + step
            losses.append(-model.log_probs(inputs, targets).sum() / n)
        value[at] = old
        assert gradients[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=1e-4)
    later = inputs.copy()
    later[:, -1] = 5
    assert np.allclose(model.log_probs(inputs, targets)[:, :-1], model.log_probs(later, targets)[:, :-1])
    before = model.log_probs(inputs, targets).sum()
    assert model.fit(inputs, targets, steps=60).log_probs(inputs, targets).sum() > before


def test_attention_works_through_many_windows_in_parts():
    r = np.random.default_rng(0)
    model = lm_scoring.Attention(np.ones(lm_scoring.CLASSES))
    inputs, targets, _ = lm_scoring.windows(r.integers(3, 20, 5_000).astype(np.int32), np.array([0, 70, 70, 5_000]))
    assert len(inputs) > 3 * lm_scoring.AT_ONCE
    got = model.log_probs(inputs, targets)
    assert len(model.room) == lm_scoring.AT_ONCE * (lm_scoring.WINDOW - lm_scoring.CONTEXT)
    assert np.allclose(got, np.concatenate([model.log_probs(inputs[i : i + 1], targets[i : i + 1]) for i in range(len(inputs))]), atol=1e-5)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, small, monkeypatch):
    if small:
        for name, value in (("BLOCK", 64), ("QUERIES", 16), ("TOGETHER", 1), ("ROTATED", 3), ("AXES", 2), ("STEP", 16)):
            monkeypatch.setattr(topk_search, name, value)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.5 + (i % 3), 8)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (7, rows[7][1]), (305, rows[3][1]), (306, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    valid = [(i, np.floor(256 * np.array([*v, *[0] * (8 - len(v))], np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    got = collections.defaultdict(list)
    for x in topk_search.top_k(vectors, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q, v in valid:
        if q % 10 == 0:
            assert got[q] == [(d, s) for s, d in sorted(((int(v @ w), d) for d, w in valid if d != q), key=lambda p: (-p[0], p[1]))[:5]]
    assert topk_search.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert topk_search.top_k(vectors.where("vec_id < 3"), F.lit(True)).count() == 6


def warc(http, record="1", more=b"", length=None):
    size = len(http) if length is None else length
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%b>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n%bContent-Length: %b\r\n\r\n%b\r\n\r\n" % (record.encode(), more, str(size).encode(), http)


def test_warc(spark, tmp_path):
    import gzip

    page = b"<title>T</title><p>one &amp; two</p><script>x</script><p>three"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<title>caf\xe9\r\nforged: 1</title>caf\xe9"
    packed = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(page)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>on\r\n6;x=y\r\ne</p>\n\r\n0\r\n\r\n"
    broken = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: a; charset=none-such\r\n\r\nnot gzip"
    bodies = {"1": plain, "2": latin, "3": packed, "4": chunked, "5": broken, "6": b""}
    file = b"".join(warc(b, r) for r, b in bodies.items())
    file = warc(plain, "bad", length="many") + warc(plain, "own", b"WARC-Payload-Digest: sha1:ABC\r\n") + file + b"noise" + warc(plain, "short", length=10**9)
    (tmp_path / "a.warc").write_bytes(file)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc(b, "z" + r)) for r, b in bodies.items()) + b"\x1f\x8bdamaged")
    responses = warc_derive.read_responses(spark, str(tmp_path / "*.warc*"))
    got = {(r.refers_to[10:-1], r.record_type): r for r in warc_derive.derive(responses).collect()}
    assert {k for k, _ in got} == {*bodies, *("z" + r for r in bodies), "own"}
    for z in ("", "z"):
        text = {r: got[z + r, "conversion"].block for r in bodies}
        assert text == {"1": "T\none & two\nthree", "2": "café forged: 1\ncafé".replace(" forged", "\nforged"), "3": "T\none & two\nthree", "4": "one", "5": "not gzip", "6": ""}
        for r, http in bodies.items():
            raw = http.partition(b"\r\n\r\n")[2]
            metadata = got[z + r, "metadata"]
            assert metadata.payload_digest == "sha256:" + hashlib.sha256(raw).hexdigest() == got[z + r, "conversion"].payload_digest
            assert f"source-bytes: {len(raw)}\r\n" in metadata.block and metadata.source_headers == http.partition(b"\r\n\r\n")[0].decode()
            assert metadata.concurrent_to == got[z + r, "conversion"].record_id and got[z + r, "conversion"].concurrent_to == metadata.record_id
    assert got["own", "metadata"].payload_digest == "sha1:ABC" and got["2", "metadata"].block.startswith("title: café forged: 1\r\n")
    records = warc_derive.derive(responses.where("record_id = '<urn:uuid:2>'"))
    warc_derive.write_records(records, str(tmp_path / "out"))
    data = b"".join(r.record for r in spark.read.parquet(str(tmp_path / "out")).collect())
    warc_derive.write_warc(records, str(tmp_path / "files"))
    stored = b"".join(f.read_bytes() for f in sorted((tmp_path / "files").glob("part-*")))
    for raw in (data, stored):
        parsed = {h["warc-type"]: (h, b) for h, b in warc_derive._parsed(raw)}
        assert parsed["conversion"][1].decode() == got["2", "conversion"].block and parsed["metadata"][0]["warc-refers-to"] == "<urn:uuid:2>"


def test_warc_odd_pages(spark):
    deep = "<!-- " * 100_000 + "<script>" * 100_000 + "<head>" * 100_000 + "<title>" * 100_000 + "<p " * 100_000
    rows = [(1, None, None), (2, "u", ""), (3, "u", deep), (4, "u", "a<head><title>x</title></head>b<head>c"), (5, "u", "a<script>b"), (6, "u", "<head>" * 100_000 + "<title>" * 100_000 + "<p " * 100_000), (2, "u", "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, record_type string, block string")
    found = warc_derive.derive(warc_derive.responses_of_pages(docs), ("page_id",))
    assert found.where("block is null or record_id is null").count() == 0 and found.where("page_id = 2").count() == 4
    assert {r.page_id: r.block for r in found.where("record_type = 'conversion' and page_id in (3, 4, 5)").collect()} == {3: "", 4: "abc", 5: "a"}
    assert warc_derive.derive(warc_derive.responses_of_pages(docs.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    cols = sorted(found.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(want.select(*cols).fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in sorted(docs.items()) if t and re.search(r"[^\W\d_]", t)]
    first = {d for d, _, c in brute_components(kept, corpus_pipeline.WORDS, corpus_pipeline.SIMILAR) if d == c}
    hits = {d: brute_hits(items, docs[d]) for d in first}
    want = {d for d, (n, hit, *_) in hits.items() if not (hit and 20 * hit >= n)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_free", "secret_free", "tokens"]
    codec = bpe_codec.Codec(bpe_codec.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    changed = [d for d, r in got.items() if codec.decode(r.ids).decode() != docs[d]]
    assert changed and all("[" in codec.decode(got[d].ids).decode() for d in changed)
    assert len(changed) < 40


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    sf, schema = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long, _more int, score double"
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 200 and 2000").limit(6).collect()]
    rows = [(i, t, "en", "s", 1, 7, 0.5) for i, t in enumerate(prose)] + [(20, "\u1234\u1235\u1236" * 30, None, "s", 1, 7, 0.5), (21, prose[0] + " end", None, None, None, None, None), (22, None, "en", "s", 0, 1, 1.0), (23, "12 34", "en", "s", 0, 1, 1.0), (None, prose[1], None, "s", 1, 1, 1.0)]
    rows += [rows[0], rows[0], (0, prose[2] + " more", "en", "s", 1, 7, 0.5), (24, "password: hunter2hunter2 " + prose[3][:300], "en", "s", 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name != "tokens":
            assert stage(spark, docs, sf).columns == P.COLUMNS, name
    spoken = [(r.doc_id, r.lang) for r in P.language(spark, docs, sf).collect()]
    assert not {20, 22, 23} & {d for d, _ in spoken} and (21, "en") in spoken and (None, "en") in spoken and len(spoken) == len(rows) - 3
    assert P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf).count() == len(rows) - 2
    left = collections.Counter((r.doc_id, r.text) for r in P.near_copies(spark, docs, sf).collect())
    assert (21, prose[0] + " end") not in left and left[(0, prose[0])] == 1 and left[(0, prose[2] + " more")] == 1 and left[(None, prose[1])] == 1 and (2, prose[2]) not in left
    assert P.benchmark_free(spark, docs, sf).count() == len(rows)
    hidden = {r.text: r.n_chars for r in P.secret_free(spark, docs, sf).where("doc_id = 24").collect()}
    assert all(t.startswith("[assign] ") and n == len(t) for t, n in hidden.items())
    assert P.tokens(spark, docs, sf).count() == len(rows)


def test_word_hashes_do_not_depend_on_slices():
    import pyarrow as pa

    from clueforge.llm._text import utf8, word_hashes

    data, offsets = utf8(pa.array(["hello world " + "x" * 50 + "Yz é foo", "", "a" * 33 + " b", "FOO"]))
    whole, counts = word_hashes(data, offsets, jaccard_join.IS_WORD)
    cut, same = word_hashes(data, offsets, jaccard_join.IS_WORD, most=8)
    assert (whole == cut).all() and (counts == same).all()
    assert whole[4] == whole[-1] or whole[3] == whole[-1]


def test_batches_take_little_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    from clueforge.llm import language_id

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh  "), 4_000).tolist())
    batch = pa.record_batch({"lang": ["xx"] * 1_000, "text": [text] * 1_000})
    rows = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), schema=collections.defaultdict(lambda: SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "string"))), mapInArrow=lambda f, _: f)
    judged = decontaminate._judged(rows, decontaminate.Items([("a", decontaminate._hashed("no such words"))]), False, (), False)
    for run in (lambda: language_id._counted(iter([batch]), ["xx"], 1 << 16, 32), lambda: judged(iter([batch]))):
        list(run())  # what is kept for good
        tracemalloc.start()
        assert sum(x.num_rows for x in run()) in (1, 1_000)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40_000_000, peak


def test_pipeline_learns_names_from_all_rows(spark, monkeypatch):
    import corpus_pipeline
    from clueforge.llm import secret_scan

    taken = []
    frequent = secret_scan.frequent_words
    monkeypatch.setattr(secret_scan, "frequent_words", lambda tokens: taken.append({r.value: r.n for r in tokens.collect()}) or frequent(tokens))
    docs = spark.range(5_000).selectExpr("id AS doc_id", "if(id % 1000 = 3, 'rareword of', 'common of') AS text", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    assert corpus_pipeline.secret_free(spark, docs, "").count() == 5_000
    assert taken == [{"rareword": 5, "common": 4_995}]


def test_rare_silent_elements_are_removed_wherever_they_arise(spark):
    pages = ["a<noscript>b</noscript>c", "a<nos<!-- x -->cript>b</noscript>c", "a<TEMPLATE x>b</template>c", "a<temp<noscript>q</noscript>late>b</template>c", "a<no<script></script>script>b", "a<nav>b</nav>c", " \n a \n\n b \n ", "", None]
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    bodies = rows.select("page_id", warc_derive.body_text(F.col("html")).alias("body"))
    got = {r.page_id: r.t for r in bodies.select("page_id", warc_derive.plain_text(F.col("body")).alias("t")).collect()}
    assert got == {0: "ac", 1: "ac", 2: "ac", 3: "ac", 4: "a", 5: "a\nb\nc", 6: "a\nb", 7: "", 8: None}
    blocks = {r.page_id: r.block for r in warc_derive.derive(warc_derive.responses_of_pages(rows), ("page_id",)).where("record_type = 'conversion'").collect()}
    assert blocks == got | {8: ""}


def test_a_worker_keeps_one_operators_caches():
    from clueforge.llm import _text

    first = _text.kept("a", dict)
    assert _text.kept("a", dict) is first
    _text.kept("b", dict)
    assert list(_text._kept) == ["b"] and _text.kept("a", dict) is not first
    _text.release()
    assert not _text._kept


def test_lm_trains_on_every_window(spark):
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(200)) for i in range(6_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blank = lambda: lm_scoring.Vocabulary((np.empty(0, np.int64), np.empty(0, np.int64)), (np.empty(0, np.int64), np.empty(0, np.int64)), 0, 0)
    found = lm_scoring._training_windows(docs, "text", blank(), 5).toArrow()
    inputs, targets = lm_scoring._unpacked_windows(found)
    assert len(inputs) == 6_000 * -(-201 // (lm_scoring.WINDOW - lm_scoring.CONTEXT)) > 32_768
    assert (targets >= 0).sum() == 6_000 * 201
    met = []

    class Watched(lm_scoring.Attention):
        def gradients(self, inputs, targets):
            met.append(inputs[:, -1])
            return {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}

    numbers = np.repeat(np.arange(1_000)[:, None], lm_scoring.WINDOW, 1)
    Watched(np.ones(lm_scoring.CLASSES)).fit(numbers, numbers, -(-1_000 // lm_scoring.BATCH))
    assert set(np.concatenate(met).tolist()) == set(range(1_000))


def test_lm_training_works_through_a_batch_in_parts():
    r = np.random.default_rng(0)
    model = lm_scoring.Attention(r.uniform(1, 9, lm_scoring.CLASSES))
    inputs, targets, _ = lm_scoring.windows(r.integers(3, 90, 5_000).astype(np.int32), np.array([0, 70, 70, 5_000]))
    got = model.gradients(inputs[:130], targets[:130])
    assert len(model.room) == lm_scoring.LEARNT_AT_ONCE * (lm_scoring.WINDOW - lm_scoring.CONTEXT)
    share = (targets[:130] >= 0).sum(1) / (targets[:130] >= 0).sum()
    each = [model.gradients(inputs[i : i + 1], targets[i : i + 1]) for i in range(130)]
    for name in model.NAMES:
        assert np.allclose(got[name], sum(s * g[name] for s, g in zip(share, each, strict=True)), atol=1e-6)


@pytest.mark.parametrize("size", [1.0, 40.0, 4_000.0])
def test_attention_of_any_size_of_weights(size):
    r = np.random.default_rng(1)
    model = lm_scoring.Attention(np.ones(lm_scoring.CLASSES))
    model.head, model.bias, model.qkv = (np.float32(size) * r.normal(0, 0.1, x.shape).astype(np.float32) for x in (model.head, model.bias, model.qkv))
    inputs, targets, _ = lm_scoring.windows(r.integers(3, 90, 700).astype(np.int32), np.array([0, 70, 70, 700]))
    x, d, context = model.embed.astype(float)[inputs] + model.place, lm_scoring.WIDTH, lm_scoring.CONTEXT
    q, k, v = (x @ model.qkv[:, i * d : (i + 1) * d].astype(float) for i in range(3))

    def softmax(x):
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    weight = softmax(q[:, context:] @ k.transpose(0, 2, 1) / math.sqrt(d) + model.mask)
    h = x[:, context:] + weight @ v @ model.out
    logits = h @ model.head.astype(float) + model.bias
    logs = logits - logits.max(-1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(-1, keepdims=True))
    want = np.where(targets >= 0, np.take_along_axis(logs, np.maximum(targets, 0)[..., None], -1)[..., 0], 0)
    assert np.allclose(model.log_probs(inputs, targets), want, rtol=2e-3, atol=2e-4)
    g = np.where(targets[..., None] >= 0, np.exp(logs) - np.eye(lm_scoring.CLASSES)[np.maximum(targets, 0)], 0) / (targets >= 0).sum()
    got = model.gradients(inputs, targets)
    assert all(np.isfinite(x).all() for x in got.values())
    assert np.allclose(got["bias"], g.sum((0, 1)), atol=2e-4) and np.allclose(got["head"], np.einsum("wpd,wpc->dc", h, g), atol=2e-4 * max(1, np.abs(h).max()))


def test_places_of_hashes():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 1_000):
        keys = np.unique(np.concatenate([r.integers(0, 1 << 64, n, np.uint64), np.array([0, 5, 6, (1 << 64) - 1], np.uint64)[: n // 2]]))
        values = np.concatenate([keys, keys + np.uint64(1), r.integers(0, 1 << 64, 500, np.uint64)])
        at, there = lm_scoring.Places(keys).find(values)
        assert there.tolist() == np.isin(values, keys).tolist() and (keys[at[there]] == values[there]).all()


def test_lm_hashes_each_text_once(spark, monkeypatch):
    import pyarrow as pa

    from clueforge.llm import _text

    model = lm_scoring.train(spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string"))
    data, offsets = _text.utf8(pa.array(["A b", None, "zz  a", "  "]))
    hashed = _text.hashed_words(data, offsets, lm_scoring.IS_WORD)
    assert [bytes(data[a:b]) for a, b in zip(*hashed[2:], strict=True)] == [b"A", b"b", b"zz", b"a"]
    monkeypatch.setattr(lm_scoring, "hashed_words", None)
    assert (lm_scoring.text_scores(data, hashed, model["vocabulary"], model["attention"]) < 0).all()


def test_lm_windows_are_stored_by_unit(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(70_000)]
    texts = [" ".join(words[i] for i in r.integers(0, 70_000, n)) for n in (0, 1, 23, 24, 25, 60, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa

    from clueforge.llm._text import utf8, word_hashes

    keys = word_hashes(*utf8(pa.array([" ".join(words)])), lm_scoring.IS_WORD)[0].view(np.int64)
    vocabulary = lm_scoring.Vocabulary((keys, np.arange(70_000)[::-1] + 1), (np.empty(0, np.int64), np.empty(0, np.int64)), 1e6, 7)
    got = lm_scoring._unpacked_windows(lm_scoring._training_windows(docs, "text", vocabulary, 3).toArrow())
    units = [[lm_scoring.SPECIAL + int(w[1:]) for w in t.split()] + [lm_scoring.END] for t in texts]
    assert max(map(max, units)) > 1 << 16
    ids, counts = np.array(sum(units, []), np.int32), np.concatenate([[0], np.cumsum([len(u) for u in units])])
    want = lm_scoring.windows(ids, counts)[:2]
    both = [sorted(np.concatenate(x, 1).tolist()) for x in (got, want)]
    assert both[0] == both[1]
    by_class = lm_scoring._unpacked_windows(lm_scoring._training_windows(docs, "text", vocabulary, 3).toArrow(), vocabulary.cls.astype(np.int8))
    assert (by_class[0] == vocabulary.cls[got[0]]).all() and (by_class[1] == np.where(got[1] < 0, -1, vocabulary.cls[got[1]])).all()


def test_subwords_of_words():
    import pyarrow as pa

    from clueforge.llm._text import hashed_words, utf8

    texts = ["a", None, "Abcdefghijk ÜBER  x", " ", "zzzzz yyyyyy"]
    data, offsets = utf8(pa.array(texts))
    value, n = lm_scoring.pieces(data, *hashed_words(data, offsets, lm_scoring.IS_WORD)[2:])
    parts = [[w.encode()[i : i + 5] for i in range(0, len(w.encode()), 5)] for t in texts for w in spaced(t)]
    assert n.tolist() == [len(p) for p in parts]
    assert value.tolist() == [sum(b << 8 * k for k, b in enumerate(p)) | len(p) << 40 | (i == 0) << 44 for w in parts for i, p in enumerate(w)]
    assert [len(x) for x in lm_scoring.pieces(*(np.empty(0, t) for t in (np.uint8, np.int64, np.int64)))] == [0, 0]
