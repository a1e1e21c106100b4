"""Packing, hard negatives and the Merkle manifest against brute force and DuckDB."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clueforge.llm import hard_negatives, merkle_manifest, vector_packing
from clueforge.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

PATH = "word_bpe_49k.json"
ODD = [None, "", " ", "\n\t ", "a", "Don't STOP, it's 2024.", "É́ ﬁ İstanbul ΣΑΣ", "a\x1cb\x1fc", "x<|endoftext|>y <|startoftext|>", "日本語 テキスト", "😀" * 50, "word " * 9_000, "x" * 50_000, "née Übergröße naïve", "the same", "the same"]


def same_as_sql(spark, name, table, rows):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{rows}')")
    answer = db.execute(ORACLE_SQL[name])
    cols = [d[0] for d in answer.description]
    return cols, sorted(map(repr, answer.fetchall()))


# --- packing


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(1)
    for cut, limits in ((True, (64, 4, 40)), (False, (64, 4, 40)), (True, (64, 100, 64)), (False, (64, 1, 64)), (True, (64, 64, 1))):
        closed = []
        packer = vector_packing.Packer(closed.append, *limits, cut=cut)
        examples = [(int(t), int(rng.integers(0, t + 1))) for t in rng.integers(1, 150, 400)]
        taken = [packer.add(i, t, p) for i, (t, p) in enumerate(examples)]
        packer.pack()
        at = collections.Counter()
        for pieces in closed:
            length, bearing = sum(n for _, _, n in pieces), 0
            for i, start, n in pieces:
                assert start == at[i] and n > 0
                at[i] += n
                bearing += max(0, start + n - max(start, examples[i][1]))
            assert length <= limits[0] and len(pieces) <= limits[1] and bearing <= limits[2]
            assert not cut or length & (length - 1) == 0
        for i, (t, p) in enumerate(examples):
            assert taken[i] == (cut or (t <= limits[0] and t - p <= limits[2]))
            assert at[i] == t * taken[i]
        if not cut:  # no two sequences could be one
            sums = [np.array([sum(n for _, _, n in s), len(s), sum(n - min(n, examples[i][1]) for i, _, n in s)]) for s in closed]
            closed_early = sum(bool((sums[i] + sums[i + 1] <= limits).all()) for i in range(len(sums) - 1))
            assert closed_early <= len(sums) // 10


def test_dot_product_prefers_what_the_room_needs():
    closed = []
    packer = vector_packing.Packer(closed.append, 100, 10, 50, cut=False)
    for name, (tokens, prompt) in enumerate([(50, 0), (50, 50), (50, 0), (50, 50)]):  # two bear loss only, two none
        packer.add(name, tokens, prompt)
    packer.pack()
    assert sorted(sorted(i % 2 for i, _, _ in s) for s in closed) == [[0, 1], [0, 1]]


def packed(rows, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path(PATH))
    by, lengths, offsets, segments = collections.defaultdict(list), collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in rows:
        by[r.doc_id].append(r)
        lengths[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
        offsets[r.sequence_id].append((r.offset, r.length))
    assert set(by) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in offsets.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values()) and max(segments.values()) <= vector_packing.SEGMENTS
    return lengths


def test_pack_documents(spark, sf):
    docs = list(enumerate(ODD))
    odd = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, length int, start string").repartition(3)
    packed(vector_packing.pack_documents(odd, tokenizer_path(PATH)).collect(), docs)
    found = vector_packing.pack_documents(odd, tokenizer_path(PATH), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    many = spark.createDataFrame([(None, None)] * 700, "doc_id long, text string").coalesce(1)
    sizes = collections.Counter(r.sequence_id for r in vector_packing.pack_documents(many, tokenizer_path(PATH)).collect())
    assert sorted(sizes.values()) == [4, 8, 16, 32, 128, 256, 256]
    assert vector_packing.pack_documents(many.limit(0), tokenizer_path(PATH)).count() == 0
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = packed(QUERIES["op11_packing"](spark, sf).collect(), [(r.doc_id, r.text) for r in whole.collect()])
    assert sum(n == 4096 for n in lengths.values()) >= 0.8 * len(lengths)


def test_words_are_looked_up_by_hash():
    import pyarrow as pa

    library = vector_packing._Ids(tokenizer_path(PATH))
    special = next(iter(library.tokenizer.get_added_tokens_decoder().values())).content
    texts = ["Word word's WORD.", "word", None, "", "x" * 99, "a\x1cb\xa0c d\u2003E", "\u0130\u03a3 \u0301e", f"one{special}TWO two", special.upper(), "word two"]
    for _ in range(2):
        got = library.encode(pa.array(texts))
        assert [x.tolist() for x in got] == [library.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    # One entry for all cases of a word, none for long ones.
    before = len(library.keys)
    library.encode(pa.array(["wOrD new NEW", "New " + "y" * 99]))
    assert len(library.keys) == len(library.places) == len(library.ends) - 1 == before + 1


def test_other_tokenizers_are_asked_whole(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = vector_packing.pack_documents(spark.createDataFrame(list(enumerate(ODD[:9])), "doc_id long, text string"), path, with_ids=True).collect()
    for i, t in enumerate(ODD[:9]):
        assert [x for r in sorted(rows, key=lambda r: r.start) if r.doc_id == i for x in r.ids] == [*lib.encode(t or "", add_special_tokens=False).ids, 2]


def test_pack_examples(spark, sf):
    from clueforge.llm.token_counts import count_tokens

    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    counted = count_tokens(turns, tokenizer_path("byte_bpe_50k.json"), "key").withColumnRenamed("doc_id", "key").join(turns.select("key", "conv_id", "role"), "key")
    examples = counted.groupBy("conv_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(0)).alias("bearing"))
    rows = vector_packing.pack_examples(examples, F.col("conv_id"), F.col("tokens"), F.col("bearing"), (2048, 8, 700)).collect()
    assert len(rows) == examples.count()
    sums = collections.defaultdict(lambda: np.zeros(3, int))
    for r in rows:
        if r.sequence_id is None:
            assert r.tokens > 2048 or r.bearing > 700
        else:
            sums[r.sequence_id] += (r.tokens, 1, r.bearing)
    assert all((s <= (2048, 8, 700)).all() for s in sums.values())
    odd = spark.createDataFrame([(1, None, 1), (2, 5, None), (3, 0, 0), (4, 9, 20), (5, 11, 0), (6, 3, -1), (None, 2, 2), (None, 2, 2)], "k long, t long, b long")
    got = vector_packing.pack_examples(odd, F.col("k"), F.col("t"), F.col("b"), (10, 2, 9)).collect()
    assert len(got) == 8 and {r.key for r in got if r.sequence_id is None} == {1, 2, 5}


# --- hard negatives


def brute(rows, anchors, positives=5, negatives=5):
    out = []
    for a, label, v in dict.fromkeys(anchors):
        own = sorted((-int(np.dot(v, x)), i) for i, other, x in rows if other == label and i != a)[:positives]
        rest = sorted((-int(np.dot(v, x)), i) for i, other, x in rows if other != label and i != a)
        for s, p in own:
            near = [(t, i) for t, i in rest if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("tree", [1, 70, 4_000])
def test_hard_negatives_brute_force(spark, tree):
    rng = np.random.default_rng(tree)
    centres = rng.normal(size=(6, 5))
    rows = [(int(i), int(rng.integers(0, 3)), tuple(np.round(centres[i % 6] + rng.normal(size=5) / 3, 1).tolist())) for i in rng.integers(0, 900, 600 if tree > 1 else 60)]
    rows += rows[:5]
    vectors = spark.createDataFrame([(i, list(v), label, "x") for i, label, v in rows], "vec_id long, embedding array<double>, label int, rank string")
    found = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, F.col("label"), tree=tree).collect()
    whole = [(i, label, tuple(np.floor(256 * np.array(v)).astype(int).tolist())) for i, label, v in rows]
    assert sorted(map(tuple, found)) == brute(whole, [r for r in whole if r[0] % 10 == 0])


def test_hard_negatives_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    bad = [(0, None, 1), (100, [nan, 1.0], 1), (200, [inf, 1.0], 1), (300, [None, 1.0], 1), (400, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    mine = lambda rows: sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, F.col("label")).collect()))
    assert mine([]) == [] and mine(bad) == [] and mine([(100, [1.0], 1)]) == [] and mine([(1, [1.0], 1), (2, [1.0], 2)]) == []
    rows = [*bad, (500, [1.0, 0.0], 1), (500, [1.0, 0.0], 1), (1, [1.0], 1), (2, [1.0, 0.0, 0.0], 2), (3, [1.0, 0.0], 2), (4, [0.9, 0.0], 3), (5, [-1.0, 0.0], 3)]
    assert mine(rows) == [(500, 1, 1, 2, 65536, 65536), (500, 1, 2, 3, 65536, 65536), (500, 1, 3, 4, 65536, 256 * 230)]
    huge = [(100, [3e15], 1), (1, [3e15], 1), (2, [2.9e15], 2), (3, [1.0], 2)]  # products wrap around: no bound holds, and none is used
    assert isinstance(mine(huge), list)


def test_hard_negatives_sql(spark, sf):
    cols, want = same_as_sql(spark, "op12_hard_negatives", "embeddings", f"{sf}/embeddings.parquet")
    assert sorted(map(repr, map(tuple, QUERIES["op12_hard_negatives"](spark, sf).select(cols).collect()))) == want


def test_ball_tree_prunes():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(40, 8)).repeat(100, axis=0) + rng.normal(size=(4000, 8)) / 50)).astype(np.int64)
    tree = hard_negatives.grow(np.arange(4000), np.arange(4000) // 100 % 4, x)
    for k, (a, b) in enumerate(tree.spans):
        if b > a:
            assert (np.linalg.norm(tree.x[a:b] - tree.centres[k], axis=1) <= tree.radii[k] * (1 + 1e-9)).all()
    least = np.full(1, hard_negatives.LEAST)
    asked = hard_negatives.Asked(x[:1], np.array([0]), np.array([0]), np.array([0]), least, np.array([hard_negatives.MOST]), least, True, 5)
    search = hard_negatives.Search(asked)
    search.tree(tree)
    assert 0 < search.visited < len(tree.spans) // 2


# --- Merkle manifest


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) by the definition, for rows (doc_id, text, lang, source, n_chars)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda d, t, lang, s, n: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)])

    def climb(nodes):
        """The levels, and each node's (left, right) by level."""
        sides, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(level) > 1:
            for i, p in enumerate(at):
                run = p - p % 3
                sides[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
            level = [h(*level[a : a + 3]) for a in range(0, len(level), 3)]
            at = [p // 3 for p in at]
        return level[0], sides

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r, leaf(*r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
    trees = [climb([m[1] for m in groups[n]]) for n in names]
    root, tops = climb([t[0] for t in trees])
    out = []
    for name, (subroot, sides), top in zip(names, trees, tops, strict=True):
        for (r, own), path in zip(groups[name], sides, strict=True):
            path = path + top
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf(r[0], None if r[1] is None else r[1].replace("\n", ""), *r[2:])
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], own, subroot, root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(map(repr, out))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


@pytest.mark.parametrize("rows", [
    [],
    [(7, None, None, None, None)],
    [(i, f"a\n{i}", "en", "one", i) for i in range(2_300)],  # more than one block
    [(i % 50, "x\ny" if i % 3 else None, None, [None, "", "-", "a", "é", "z" * 300][i % 6], 1) for i in range(400)] + [(None, "\n", "", "a", None)] * 3,
    [(i, "t\n", "en", f"s{i}", 0) for i in range(800)],  # more sources than a block holds
])
def test_manifest_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found = merkle_manifest.manifest(docs)
    assert sorted(map(repr, map(tuple, found.collect()))) == (plain_manifest(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 81, 100, 243])
def test_traversal_emits_each_path(n):
    levels = merkle_manifest.height(n)
    for tall in (levels, levels + 1, 6):
        leaves = [f"{i:064x}" for i in range(n)]
        root = merkle_manifest.subtree_root(leaves, tall)
        walk = merkle_manifest.Traversal(leaves, tall)
        seen = 0
        for leaf, path in zip(leaves, walk.paths(), strict=True):
            node = leaf
            for left, right in path:
                node = merkle_manifest.digest(left, node, right)
            assert node == root and len(path) == tall
            seen += 1
        assert seen == n


def test_manifest_sql(spark, sf):
    cols, want = same_as_sql(spark, "op13_merkle_manifest", "documents", f"{sf}/documents.parquet")
    assert sorted(map(repr, map(tuple, QUERIES["op13_merkle_manifest"](spark, sf).select(cols).collect()))) == want


# --- rows to learn from


def test_rows_without_an_id_are_learnt_from(spark):
    from clueforge.llm._text import training_row

    rows = spark.createDataFrame([(i,) for i in [None, *range(40)]], "doc_id long").select("doc_id", training_row("doc_id", 4, 2).alias("learn")).collect()
    assert {r.doc_id: r.learn for r in rows} == {i: i is None or zlib.crc32(str(i).encode()) % 4 != 2 for i in [None, *range(40)]}


def test_rows_that_share_an_id_are_sampled_one_by_one(spark):
    from clueforge.llm import language_id

    words = {"en": "the and with they", "es": "que los con para"}
    for shared in range(5):
        rows = [(shared, f"{words['en']} {i}", "en") for i in range(60)] + [(i, f"{words['es']} {i}", "es") for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.train(docs, rows_per_language=20)
        found = language_id.predict(spark.createDataFrame([(1, "the and they"), (2, "los con que")], "doc_id long, text string"), model, {"doc_id": F.col("doc_id")}).collect()
        assert {r.doc_id: r.lang_pred for r in found} == {1: "en", 2: "es"}
