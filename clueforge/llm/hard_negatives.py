"""Hard negatives of labelled vectors by branch and bound over ball trees (operator 12).

Vectors are dealt to cells around pivots, so that a partition holds neighbours,
and every partition builds ball trees over blocks of them, once, in a stored
table. A node keeps its centre c, its radius r and its labels: for an anchor q,
no inner product below it exceeds q.c + |q| r or falls below q.c - |q| r. The
anchors are a stated query set; blocks of them, bounded in bytes, are broadcast
one after another to the tasks that read the trees, so no vector is shuffled to
meet an anchor. Trees are read in waves, each some GROWTH times the wave before:
the best scores found so far go along, and a node is pruned when it lies outside
the score window or strictly below the present k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.llm.topk_search import _matrix, integers
from clueforge.session import materialise

#: Vectors of a tree at most, and of a leaf; bytes of a tree's matrix; bytes of the anchors that are broadcast at once and of a row of them; pivots of the cells, and the rows of the sample that they come from; how much larger each wave is than the one before.
TREE, LEAF, TREE_BYTES, ANCHOR_BYTES, ROW_BYTES, PIVOTS, SAMPLE, GROWTH = 16_384, 64, 4 << 20, 32 << 20, 1 << 20, 64, 4_096, 16

LEAST, MOST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)

_FOREST = "tree long, ids binary, labels binary, matrix binary, centres binary, radii binary, spans binary"
_FOUND = "query long, id long, score long"


@dataclass
class Tree:
    """A ball tree in arrays: node k holds rows spans[k] and its children are 2k + 1 and 2k + 2 (an empty span is none)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    spans: np.ndarray

    def __post_init__(self) -> None:
        # Where a node has one label only, and which; a node with several has none to compare.
        low = [self.labels[a:b].min() if b > a else 0 for a, b in self.spans]
        high = [self.labels[a:b].max() if b > a else 0 for a, b in self.spans]
        self.low, self.high = np.array(low), np.array(high)
        self.largest = float(np.abs(self.x).max(initial=0))


def grow(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Tree:
    """Halves the rows again and again along the line between two far points, until a node has LEAF rows at most."""
    n = len(ids)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    nodes = 2 ** (depth + 1) - 1
    spans, centres, radii = np.zeros((nodes, 2), np.int64), np.zeros((nodes, x.shape[1])), np.zeros(nodes)
    spans[0] = (0, n)
    order = np.arange(n)
    xf = x.astype(float)
    for k in range(nodes):
        a, b = spans[k]
        if b == a:
            continue
        own = xf[order[a:b]]
        centres[k] = own.mean(axis=0)
        radii[k] = np.sqrt(((own - centres[k]) ** 2).sum(axis=1).max())
        if 2 * k + 2 < nodes:
            far = own[((own - centres[k]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            middle = (a + b) // 2
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            spans[2 * k + 1], spans[2 * k + 2] = (a, middle), (middle, b)
    return Tree(ids[order], labels[order], x[order], centres, radii, spans)


@dataclass
class Asked:
    """Queries: each an anchor's place, a label that a result must (`same`) or must not have, a score window, and the k-th score so far."""

    anchors: np.ndarray
    own: np.ndarray
    at: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool
    k: int


class Search:
    """Finds the k best rows of each query in one tree after another, ties to the smaller id."""

    def __init__(self, asked: Asked):
        n = len(asked.at)
        self.asked = asked
        self.scores = np.full((n, asked.k), LEAST)
        self.ids = np.full((n, asked.k), MOST)
        self.held = np.zeros(n, np.int64)  # how many of them are found
        self.floor = np.maximum(asked.floor, asked.low)
        self.q = asked.anchors.astype(float)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.visited = 0

    def tree(self, tree: Tree) -> None:
        width = self.asked.anchors.shape[1]
        product = float(np.abs(self.asked.anchors).max(initial=0)) * tree.largest * width
        #: Beyond this, products may wrap around and bounds mean nothing: every row is looked at.
        self.exact, self.bounded = product < 2**52, product < 2**61
        self._node(tree, 0, np.arange(len(self.asked.at)))

    def _node(self, tree: Tree, k: int, live: np.ndarray) -> None:
        a, b = tree.spans[k]
        asked = self.asked
        if b == a or not len(live):
            return
        if asked.same:
            live = live[(asked.label[live] >= tree.low[k]) & (asked.label[live] <= tree.high[k])]
        elif tree.low[k] == tree.high[k]:
            live = live[asked.label[live] != tree.low[k]]
        if self.bounded and len(live):
            places, back = np.unique(asked.at[live], return_inverse=True)
            middle = (self.q[places] @ tree.centres[k])[back]
            reach = self.norm[asked.at[live]] * tree.radii[k]
            slack = 1e-9 * (np.abs(middle) + self.norm[asked.at[live]] * (np.linalg.norm(tree.centres[k]) + tree.radii[k])) + 1e-6
            live = live[(middle + reach + slack >= self.floor[live]) & (middle - reach - slack <= asked.high[live])]
        if not len(live):
            return
        self.visited += 1
        if 2 * k + 2 >= len(tree.spans):
            self._leaf(tree, a, b, live)
            return
        # The side that promises more comes first: it raises the k-th scores.
        left, right = 2 * k + 1, 2 * k + 2
        if self.q[asked.at[live]].mean(axis=0) @ (tree.centres[right] - tree.centres[left]) > 0:
            left, right = right, left
        self._node(tree, left, live)
        self._node(tree, right, live)

    def _leaf(self, tree: Tree, a: int, b: int, live: np.ndarray) -> None:
        asked, x = self.asked, tree.x[a:b]
        places, back = np.unique(asked.at[live], return_inverse=True)
        q = asked.anchors[places]
        whole = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if self.exact else q @ x.T
        scores = whole[back]
        right = (tree.labels[None, a:b] == asked.label[live, None]) == asked.same
        right &= (scores >= self.floor[live, None]) & (scores <= asked.high[live, None]) & (tree.ids[None, a:b] != asked.own[live, None])
        some = right.any(axis=1)
        if not some.any():
            return
        live, scores, right = live[some], scores[some], right[some]
        ids = np.where(right, tree.ids[None, a:b], MOST)
        scores = np.where(right, scores, LEAST)
        ids, scores = np.concatenate([self.ids[live], ids], axis=1), np.concatenate([self.scores[live], scores], axis=1)
        free = np.concatenate([np.arange(asked.k)[None, :] >= self.held[live, None], ~right], axis=1)
        best = np.lexsort((ids, -scores.astype(float) if self.exact else -scores, free), axis=1)[:, : asked.k]
        row = np.arange(len(live))[:, None]
        self.ids[live], self.scores[live] = ids[row, best], scores[row, best]
        self.held[live] = np.minimum(asked.k, self.held[live] + right.sum(axis=1))
        full = self.held[live] == asked.k
        self.floor[live[full]] = np.maximum(self.floor[live[full]], self.scores[live[full], -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is held."""
        query, place = np.nonzero(np.arange(self.asked.k)[None, :] < self.held[:, None])
        return query, self.ids[query, place], self.scores[query, place]


def forest(rows: DataFrame, width: int, n: int, tree: int = TREE) -> DataFrame:
    """Ball trees over all rows (id, label, v), stored by wave."""
    block = max(1, min(tree, max(LEAF, TREE_BYTES // (8 * width))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / n)).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = _matrix(pa.array([r["v"] for r in sample] or [[]], pa.list_(pa.int64())), width).astype(float)
    near = rows.sparkSession.sparkContext.broadcast(pivots)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (near.value**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(2), width).astype(float)
            cell = (lengths[None, :] - 2 * x @ near.value.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], names=["cell", "id", "label", "v"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, held = TaskContext.get().partitionId() << 24, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            ids, labels, x = (np.concatenate(c) for c in zip(*waiting, strict=True))
            t = grow(ids, labels, x)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (t.ids, t.labels, t.x, t.centres, t.radii, t.spans)]], names=[c.split()[0] for c in _FOREST.split(", ")])

        for batch in batches:
            ids, labels, x = np.asarray(batch.column(1)), np.asarray(batch.column(2)), _matrix(batch.column(3), width)
            a = 0
            while a < len(ids):
                b = min(len(ids), a + block - held)
                waiting.append((ids[a:b], labels[a:b], x[a:b]))
                held, a = held + b - a, b
                if held == block:
                    yield packed()
                    waiting, held = [], 0
        if waiting:
            yield packed()

    pieces = max(1, -(-n // block))
    cells = rows.mapInArrow(celled, "cell long, id long, label long, v array<long>")
    trees = cells.repartitionByRange(pieces, "cell", "id").sortWithinPartitions("cell", "id").mapInArrow(built, _FOREST)
    waves = max(0, int(np.floor(np.log(pieces) / np.log(GROWTH))))
    part = F.pmod(F.xxhash64("tree"), F.lit(GROWTH**waves))
    wave = F.lit(0)
    for w in range(1, waves + 1):
        wave = F.when(part >= GROWTH ** (w - 1), w).otherwise(wave)
    return materialise(trees.withColumn("wave", wave), "ball-trees", "wave")


def _searched(trees: DataFrame, asked: Asked, width: int) -> DataFrame:
    """query, rank, id, score over all waves: each query's k best."""
    spark, k = trees.sparkSession, asked.k
    names = sorted(r[0] for r in trees.select("wave").distinct().collect())
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    so_far = spark.createDataFrame([], _FOUND)
    for turn, wave in enumerate(names):
        sent = spark.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state = Search(sent.value)
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, labels, x, centres, radii, spans = (batch.column(c)[row].as_py() for c in range(6))
                    state.tree(Tree(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(x, np.int64).reshape(-1, width), np.frombuffer(centres, float).reshape(-1, width), np.frombuffer(radii, float), np.frombuffer(spans, np.int64).reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in state.found()], names=["query", "id", "score"])

        found = trees.where(F.col("wave") == wave).select("ids", "labels", "matrix", "centres", "radii", "spans").mapInArrow(search, _FOUND)
        so_far = materialise(so_far.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "negatives-wave")
        if turn + 1 < len(names):
            kth = so_far.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k).toArrow()  # a number for each query of the block
            floor = asked.floor.copy()
            floor[kth.column("query").to_numpy()] = kth.column("low").to_numpy()
            asked = Asked(asked.anchors, asked.own, asked.at, asked.label, asked.low, asked.high, floor, asked.same, k)
    return so_far.withColumn("rank", F.row_number().over(best))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), vec_id: str = "vec_id", embedding: str = "embedding", tree: int = TREE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its `positives` best other rows of the same label by
    integer inner product. For each of them, the `negatives` best rows of another
    label are returned whose score s has share[0] * p <= share[1] * s <= share[1] * p,
    p being the positive's score; so negative p have none. Ties go to the smaller id.
    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Rows with the anchor's own id are not among its others. Repeated
    rows each keep a place; repeated anchors (id, label, vector) count once, and
    rows that share an id but not label and vector are anchors each. Shorter vectors
    count as padded with zeros. Products beyond a long wrap around. An empty table
    gives no rows; other columns are not read. `tree` bounds the vectors of a tree and never
    changes a result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(embedding)).alias("v"), is_anchor.alias("anchor")).where("id is not null and label is not null and v is not null")
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not head["n"]:
        return spark.createDataFrame([], schema)
    width = max(1, head["width"])
    trees = forest(rows.select("id", "label", "v"), width, head["n"], tree)
    most = max(1, ROW_BYTES // (8 * width + 16))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            x = _matrix(batch.column(2), width)
            for a in range(0, len(x), most):
                b = min(len(x), a + most)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([np.asarray(v)[a:b].tobytes()], pa.binary()) for v in (batch.column(0), batch.column(1), x)]], names=["block", "ids", "labels", "matrix"])
                number += 1

    anchors = materialise(rows.where("anchor").select("id", "label", "v").distinct().mapInArrow(packed, "block long, ids binary, labels binary, matrix binary"), "anchors")
    sizes = anchors.select("block", F.octet_length("matrix").alias("bytes")).orderBy("block").toArrow()  # a number for each MB of anchors
    turns = np.cumsum(sizes.column("bytes").to_numpy()) // ANCHOR_BYTES
    out = None
    for turn in np.unique(turns).tolist():
        names = sizes.column("block").to_numpy()[turns == turn].tolist()
        block = anchors.where(F.col("block").isin(names)).orderBy("block").toArrow()  # at most ANCHOR_BYTES and one row
        ids, labels, q = (np.frombuffer(b"".join(block.column(c).to_pylist()), np.int64) for c in ("ids", "labels", "matrix"))
        q = q.reshape(-1, width)
        n = len(ids)
        none, all_ = np.full(n, LEAST), np.full(n, MOST)
        best = _searched(trees, Asked(q, ids, np.arange(n), labels, none, all_, none, True, positives), width).toArrow()
        at, pid, score = (best.column(c).to_numpy() for c in ("query", "id", "score"))
        low = -((-share[0] * score) // share[1])  # the least score within the window
        near = _searched(trees, Asked(q, ids[at], at, labels[at], low, score, np.full(len(at), LEAST), False, negatives), width)
        # At most `positives` rows for each anchor of the block.
        pairs = F.broadcast(spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(at)), pa.int64()), "anchor_id": ids[at], "positive_id": pid, "positive_score": score})))
        found = near.join(pairs, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found = materialise(found, "negatives")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def oracle_sql(modulus: int = 100, positives: int = 5, negatives: int = 5) -> str:
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % {modulus} = 0 AND a.vec_id <> c.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {positives})
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= {negatives}
"""
