"""Exact top-k inner-product search over norm-sorted blocks (operator 1).

Vectors become integers, are rotated to the principal axes of the whole table
(an SVD of its second moments) and range-partitioned by descending length, so
each partition is a block of vectors of similar length. The longest block gives
every query a first k-th score. A block of queries then meets only the blocks
whose longest vector could still beat it; the query blocks that need one block
are split into bounded groups, each of which gets that block once. Within a pair of blocks, vectors are
processed by descending length: a sum over the leading rotated axes plus the
Cauchy-Schwarz bound of the rest prunes most of them, and exact integer products
of the others decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.session import materialise

#: The most vectors and bytes of a block, queries and bytes of a query block, query blocks that meet a block in one task, leading axes of the partial sums, vectors that are processed between two updates of the k-th scores, and components that the SVD rotates (the others stay as they are).
BLOCK, BLOCK_BYTES, QUERIES, QUERY_BYTES, TOGETHER, AXES, STEP, ROTATED = 16_384, 8 << 20, 256, 1 << 20, 16, 16, 2_048, 1_024


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(embedding.isNotNull() & ~F.exists(embedding, bad), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, shorter ones padded with zeros."""
    flat, sizes = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthogonal axes: the singular vectors of the sum of outer products over all vectors' first ROTATED components, and the other components."""
    w = min(width, ROTATED)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((w, w))
        for batch in batches:
            m = _matrix(batch.column(0), width)[:, :w].astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist())
        return pa.table({"part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    two_levels = vectors.select("v").mapInArrow(part, schema).groupBy("part").applyInArrow(added, schema).groupBy().applyInArrow(added, schema)
    axes = np.eye(width)
    for row in two_levels.collect():
        axes[:w, :w] = np.linalg.svd(np.frombuffer(row["sums"], float).reshape(w, w))[0]
    return axes


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_blocks(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, id, score) of the up to k best vectors of a block for each query that may reach its floor.

    `x` is in descending length. All comparisons allow for rounding, so no vector
    that ties with the floor is lost.
    """
    small = max(np.abs(q).max(initial=0), 1) * float(max(np.abs(x).max(initial=0), 1)) * q.shape[1] < 2**52
    qf, xf = q.astype(float), x.astype(float)
    exact = (lambda a, b: a.astype(float) @ b.astype(float).T) if small else (lambda a, b: a @ b.T)
    qr, xr = qf @ axes, xf @ axes
    h = min(AXES, q.shape[1])
    qn, xn = np.linalg.norm(qf, axis=1), np.linalg.norm(xf, axis=1)
    q_rest, x_rest = np.linalg.norm(qr[:, h:], axis=1), np.linalg.norm(xr[:, h:], axis=1)
    floor = floor.astype(float).copy()
    heap = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qids]
    slack = 1e-6 * (qn.max(initial=0) * xn.max(initial=0) + 1)
    for a in range(0, len(ids), STEP):
        b = min(a + STEP, len(ids))
        live = np.flatnonzero(qn * xn[a] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :h] @ xr[a:b, :h].T + q_rest[live, None] * x_rest[None, a:b]
        maybe = (bound + slack >= floor[live, None]) & (ids[None, a:b] != qids[live, None])
        dense = maybe.mean() > 0.05
        whole = exact(q[live], x[a:b]) if dense else None
        for row, i in enumerate(live.tolist()):
            at = np.flatnonzero(maybe[row])
            if not len(at):
                continue
            scores = whole[row, at] if dense else exact(q[i : i + 1], x[a + at])[0]
            scores = scores.astype(np.int64)
            reach = scores >= floor[i]
            if not reach.any():
                continue
            heap[i] = _best(np.concatenate([heap[i][0], scores[reach]]), np.concatenate([heap[i][1], ids[a + at[reach]]]), k)
            if len(heap[i][0]) == k:
                floor[i] = max(floor[i], heap[i][0][-1])
    return [(i, int(d), int(s)) for i, (scores, found) in enumerate(heap) for s, d in zip(scores, found, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Every row but those with the query's own id is a candidate. Rows whose id or
    vector is null, or whose vector holds a null or non-finite component, take no
    part. Shorter vectors, empty ones too, count as padded with zeros. Repeated
    candidates each keep a rank; repeated queries (id and vector) count once, and
    rows that share an id but not a vector are queries with one common list.
    Scores are longs: products that exceed them wrap around. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(embedding)).alias("v"), is_query.alias("query")).where("id is not null and v is not null")
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not head["n"]:
        return spark.createDataFrame([], out_schema)
    width = max(1, head["width"])
    block = max(64, min(BLOCK, BLOCK_BYTES // (8 * width)))
    some_queries = max(16, min(QUERIES, QUERY_BYTES // (8 * width)))
    axes = _rotation(rows, width)
    n_blocks = max(1, -(-head["n"] // block))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            m = _matrix(batch.column(1), width)
            norms = np.asarray(batch.column(2))
            for a in range(0, len(m), block):
                b = min(a + block, len(m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([float(norms[a])]), pa.array([np.asarray(batch.column(0))[a:b].tobytes()], pa.binary()), pa.array([m[a:b].tobytes()], pa.binary())],
                    names=["block", "longest", "ids", "matrix"],
                )
                number += 1

    ordered = rows.select("id", "v", norm.alias("norm")).repartitionByRange(n_blocks, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc())
    blocks = materialise(ordered.mapInArrow(packed, "block long, longest double, ids binary, matrix binary"), "blocks")
    tops = blocks.select("block", "longest").orderBy("block").toArrow()
    names, longest = tops.column("block").to_numpy(), tops.column("longest").to_numpy()
    first = blocks.where(F.col("block") == int(names[0])).select("ids", "matrix").collect()[0]
    opening = spark.sparkContext.broadcast((first["ids"], first["matrix"], axes, longest, names))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with the k-th scores of the opening block, one row for each block of vectors that they may need."""
        from pyspark import TaskContext

        ids, matrix, turn, longest, names = opening.value
        ids, matrix = np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, width)
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            qid, q = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            for a in range(0, len(qid), some_queries):
                some, own = q[a : a + some_queries], qid[a : a + some_queries]
                floor = np.full(len(own), -np.inf)
                got: dict[int, list[int]] = {}
                for i, _, s in search_blocks(own, some, floor, ids, matrix, turn, k):
                    got.setdefault(i, []).append(s)
                for i, s in got.items():
                    if len(s) == k:
                        floor[i] = min(s)
                lengths = np.linalg.norm(some.astype(float), axis=1)
                for name, top in zip(names.tolist(), longest.tolist(), strict=True):
                    near = lengths * top * (1 + 1e-9) + 1 >= floor
                    if near.any():
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([number], pa.int64()), pa.array([own[near].tobytes()], pa.binary()), pa.array([some[near].tobytes()], pa.binary()), pa.array([floor[near].tobytes()], pa.binary())], names=["block", "number", "qids", "queries", "floor"])
                number += 1

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        """A bounded group of query blocks with their one block of vectors."""
        turn = opening.value[2]
        found: list[tuple[int, int, int]] = []
        for body in right.to_pylist():
            ids, matrix = np.frombuffer(body["ids"], np.int64), np.frombuffer(body["matrix"], np.int64).reshape(-1, width)
            for row in left.to_pylist():
                qids = np.frombuffer(row["qids"], np.int64)
                found += [(int(qids[i]), d, s) for i, d, s in search_blocks(qids, np.frombuffer(row["queries"], np.int64).reshape(-1, width), np.frombuffer(row["floor"], float), ids, matrix, turn, k)]
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    queries = materialise(rows.where("query").select("id", "v").distinct().mapInArrow(asked, "block long, number long, qids binary, queries binary, floor binary"), "queries")
    groups = queries.groupBy("block").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups"))
    dealt = queries.join(F.broadcast(groups), "block").withColumn("part", F.pmod(F.xxhash64("number"), "groups").cast("int"))
    copied = blocks.join(F.broadcast(groups), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    found = dealt.select("block", "part", "qids", "queries", "floor").groupBy("block", "part").cogroup(copied.select("block", "part", "ids", "matrix").groupBy("block", "part")).applyInArrow(met, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(modulus: int = 50, k: int = 5) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.e) * len(c.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {modulus} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
