"""Merkle manifest of a table with every row's authentication path (operator 13).

Rows become digests in one scan. A range sort by source and key gives each row
its place in its source; windows over the runs of the sort, one row a run, carry
the counts from one partition to the next. BLOCK consecutive places are an
aligned block: a subtree of its own. The roots of the blocks are the leaves of
the next tree, and so on until a source has one node; the sources' roots are the
leaves of the last tree. Coming down again, the path of a block's root is joined
to the block, and each block is walked once by fractal traversal (existing and
desired subtrees), which emits the successive paths in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.operators.skew import spread_join
from clueforge.session import materialise

#: Children of a node, levels of a block's tree and of a subtree in the traversal, and the leaves of a block.
ARITY, LEVELS, STEP = 3, 6, 2
BLOCK = ARITY**LEVELS

#: The most rows of a small table that is broadcast (at most some 4 KB each: the longest path).
BROADCAST_ROWS = 10_000

#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_SQL = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the values, each "-" if null, else its UTF-8 length, ":" and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def height(n: int) -> int:
    """Levels above `n` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtree_root(nodes: list[str], levels: int) -> str:
    """The node `levels` above these, where runs of ARITY (the last may be shorter) become one."""
    for _ in range(levels):
        nodes = [digest(*nodes[a : a + ARITY]) for a in range(0, len(nodes), ARITY)]
    return nodes[0]


class Traversal:
    """Successive authentication paths of the leaves of one block, in bounded memory.

    The levels are cut in tiers of STEP. Each tier keeps an existing subtree, that
    over the present leaf, and stacks up the desired one that follows it, by
    TreeHash over the leaves, two units of work (a leaf or a hash) for each leaf
    that is emitted. A tier's subtree is exchanged for the desired one when the
    leaf leaves it. Kept are some 2 * ARITY ** STEP nodes a tier, never a level.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.counts = [-(-len(leaves) // ARITY**j) for j in range(levels + 1)]
        self.tiers = [(base, min(base + STEP, levels)) for base in range(0, levels, STEP)]

    def _grow(self, tier: int, window: int, into: dict[int, list[str]]) -> Iterator[None]:
        """Fills `into` with the tier's nodes over its `window`-th stretch of leaves; yields after each unit of work."""
        base, top = self.tiers[tier]
        first, last = window * ARITY**top, min((window + 1) * ARITY**top, len(self.leaves))
        stack: list[list[str]] = [[] for _ in range(top)]
        for p in range(first, last):
            node, place, h = self.leaves[p], p, 0
            yield
            while h < top:
                if h >= base:
                    into.setdefault(h, []).append(node)
                stack[h].append(node)
                if len(stack[h]) < ARITY and place != self.counts[h] - 1:
                    break
                if h + 1 == top:
                    stack[h] = []
                    break
                node, stack[h], place, h = digest(*stack[h]), [], place // ARITY, h + 1
                yield

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf, the siblings left and right of its ancestor on each level, concatenated."""
        existing: list[dict[int, list[str]]] = []
        desired: list[dict[int, list[str]]] = []
        growing: list[Iterator[None]] = []
        for t in range(len(self.tiers)):
            tree: dict[int, list[str]] = {}
            for _ in self._grow(t, 0, tree):
                pass
            existing.append(tree)
            desired.append({})
            growing.append(self._grow(t, 1, desired[t]))
        for p in range(len(self.leaves)):
            path = []
            for t, (base, top) in enumerate(self.tiers):
                offset = p // ARITY**top
                for h in range(base, top):
                    nodes, at = existing[t][h], p // ARITY**h - offset * ARITY ** (top - h)
                    run = at - at % ARITY
                    path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
            yield path
            for t, (_, top) in enumerate(self.tiers):
                for _ in range(2):
                    next(growing[t], None)
                if (p + 1) % ARITY**top == 0:
                    for _ in growing[t]:
                        pass
                    existing[t], desired[t] = desired[t], {}
                    growing[t] = self._grow(t, (p + 1) // ARITY**top + 1, desired[t])


def _levels(total: int) -> int:
    """Levels of a block's tree: all, unless the block is the whole tree."""
    return LEVELS if total > BLOCK else height(total)


def _roots(blocks: DataFrame) -> DataFrame:
    """owner, i, total, h: each block's root as a leaf of the next tree."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = [subtree_root(nodes, _levels(total)) for nodes, total in zip(batch.column("hs").to_pylist(), batch.column("total").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("owner"), batch.column("block"), pa.array([-(-n // BLOCK) for n in batch.column("total").to_pylist()], pa.int64()), pa.array(hs, pa.string())], names=["owner", "i", "total", "h"])

    rows = blocks.select("owner", "block", "total", F.col("members.h").alias("hs"))
    return rows.mapInArrow(roots, "owner string, i long, total long, h string")


def _walked(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """owner, the payload columns, h, path, upper and top of each member of the blocks; the path is within the block."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema["members"].dataType.elementType.fields}
    keep = ["h", *payload]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a few blocks at a time: their rows are many times larger
                part = batch.slice(at, min(16, batch.num_rows - at))
                lists = part.column("members")
                members, totals = lists.flatten(), part.column("total").to_pylist()
                sizes = np.diff(np.asarray(lists.offsets))
                hs = members.field("h").to_pylist()
                lefts, rights, marks, a = [], [], [0], 0
                for n, total in zip(sizes.tolist(), totals, strict=True):
                    for path in Traversal(hs[a : a + n], _levels(total)).paths():
                        lefts += [x for x, _ in path]
                        rights += [x for _, x in path]
                        marks.append(len(lefts))
                    a += n
                paths = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_PATH.value_type)))
                back = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                whole = [part.column(c).take(back) for c in ("owner", "upper", "top")]
                yield pa.RecordBatch.from_arrays([whole[0], *[members.field(c) for c in keep], paths, *whole[1:]], names=["owner", *keep, "path", "upper", "top"])

    top = blocks.schema["top"].dataType.simpleString()
    schema = ", ".join(["owner string", *[f"{c} {types[c]}" for c in keep], f"path {_PATH_SQL}, upper {_PATH_SQL}, top {top}"])
    return blocks.select("owner", "total", "members", "upper", "top").mapInArrow(walk, schema)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with the stored table right; on neither side has a key more rows than a block or a sorted partition."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)


def climbed(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """The blocks of the nodes (owner, block, total, members), and for each block what lies above it (owner, block, upper, top).

    `nodes` has owner, i (from 0, without gaps), total (nodes of that owner), h and
    the payload. `upper` is the path from the block's root to `top`, the owner's root.
    """
    member = F.struct("i", "h", *[c for c in payload if c != "i"])
    block = F.floor(F.col("i") / BLOCK).cast("long").alias("block")
    blocks = materialise(nodes.groupBy("owner", block).agg(F.min("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")), "merkle-blocks")
    roots = materialise(_roots(blocks), "merkle-roots")
    if (roots.agg(F.max("total")).collect()[0][0] or 0) > 1:
        above = authenticated(roots, ["i"])
    else:
        above = roots.select("owner", "i", F.array().cast(_PATH_SQL).alias("path"), F.col("h").alias("root"))
    return blocks, materialise(above.select("owner", F.col("i").alias("block"), F.col("path").alias("upper"), F.col("root").alias("top")), "merkle-upper")


def walked(blocks: DataFrame, upper: DataFrame, payload: list[str]) -> DataFrame:
    """The members of the blocks, each with its path up to `top`."""
    found = _walked(_joined(blocks, upper, ["owner", "block"]), payload)
    return found.select("owner", "h", *payload, F.concat("path", "upper").alias("path"), F.col("top").alias("root"))


def authenticated(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """owner, h, payload, path, root: each node's path to the root of its owner's tree."""
    return walked(*climbed(nodes, payload), payload)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with i, the place (from 0) among those of the same `owner` by `order` (nulls first), and total, their number.

    No task gets all rows of an owner. Of ties, any may come first.
    """
    ordered = rows.repartitionByRange("owner", *order).sortWithinPartitions("owner", *order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialise(ordered, "merkle-sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = kept.groupBy("_part", "owner").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("owner")  # one row for each partition that holds rows of the owner
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("_part", "owner", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("total")), "merkle-runs")
    return _joined(kept, runs, ["_part", "owner"]).withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def folded(first: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, first, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", owner: str = "source", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    `tampered` tells for which rows the text loses its newlines after the manifest
    is made; by default those whose id's crc32 is even. Rows are ordered by id
    (null first), then by leaf; equal rows count each, and may swap their equal
    leaves. A null source is a source of its own, before all others; an empty one
    is another. Null values and empty ones give different leaves. A table of one
    row has an empty proof. An empty table gives no rows. Other columns are not
    read. A null id is never tampered with.
    """
    if tampered is None:
        tampered = F.crc32(F.col(key).cast("string")) % 2 == 0
    values = [F.col(c) for c in fields]
    cut = [F.translate(c, "\n", "") if name == text else c for name, c in zip(fields, values, strict=True)]
    # The name of an owner is never null and sorts as the sources do.
    name = F.when(F.col(owner).isNull(), "").otherwise(F.concat(F.lit("="), F.col(owner).cast("string")))
    changed = F.when(tampered & F.contains(F.col(text), F.lit("\n")), leaf(cut))
    rows = docs.select(F.col(key).alias("doc_id"), name.alias("owner"), leaf(values).alias("h"), changed.alias("changed"))
    payload = ["doc_id", "changed"]
    blocks, upper = climbed(placed(materialise(rows, "merkle-leaves"), ["doc_id", "h"]), payload)
    subroots = upper.where("block = 0").select(F.lit("").alias("owner"), F.col("owner").alias("name"), F.col("top").alias("h"))
    sources = authenticated(placed(subroots, ["name"]), ["name"]).select(F.col("name").alias("owner"), F.col("path").alias("last"), "root")
    sources = materialise(sources, "merkle-sources")
    if sources.count() <= BROADCAST_ROWS:
        upper = upper.join(F.broadcast(sources), "owner")
    else:
        upper = spread_join(upper, sources, "owner", "inner")
    upper = upper.select("owner", "block", F.concat("upper", "last").alias("upper"), F.struct("top", "root").alias("top"))
    found = walked(blocks, materialise(upper, "merkle-upper"), payload)
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    found = found.select("doc_id", F.col("h").alias("leaf"), F.col("root.top").alias("subroot"), F.col("root.root").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("changed", "h"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 13, source_levels: int = 8) -> str:
    """The same in SQL, for sources of up to ARITY ** levels rows and ARITY ** source_levels sources.

    DuckDB has no crc32: the bits of the id's digits go through its register one by one.
    """
    fields = lambda text: " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in (*FIELDS[:-1], text))
    bits = "list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda k: (ord((doc_id::VARCHAR)[k // 8 + 1]) >> (k % 8)) & 1)"
    register = f"list_reduce({bits}, lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295)"
    steps = [f"""
WITH leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256({fields("text")}) AS leaf,
    CASE WHEN xor({register}, 4294967295) % 2 = 0 THEN sha256({fields("replace(text, chr(10), '')")}) ELSE sha256({fields("text")}) END AS tampered
  FROM documents
), s0 AS MATERIALIZED (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h, row FROM leaves
), f0 AS MATERIALIZED (SELECT row, doc_id, leaf, s0.g, s0.i, tampered AS cur, '' AS proof FROM leaves JOIN s0 USING (row))"""]

    def level(k: int, nodes: str, fold: str, g: str) -> str:
        left, right = f"array_to_string(r.l[1:f.i % {ARITY}], '')", f"array_to_string(r.l[f.i % {ARITY} + 2:], '')"
        return f"""
, r{k} AS MATERIALIZED (SELECT g, i // {ARITY} AS run, n, list(h ORDER BY i) AS l FROM {nodes} GROUP BY g, i // {ARITY}, n)
, s{k + 1} AS MATERIALIZED (SELECT g, run AS i, (n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h FROM r{k})
, f{k + 1} AS MATERIALIZED (
  SELECT f.* REPLACE (f.i // {ARITY} AS i, CASE WHEN r.n > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof)
  FROM {fold} f JOIN r{k} r ON {g} = r.g AND f.i // {ARITY} = r.run
)"""

    for k in range(levels):
        steps.append(level(k, f"s{k}", f"f{k}", "f.g"))
    steps.append(f"""
, t AS MATERIALIZED (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM s{levels})
, f AS MATERIALIZED (SELECT f{levels}.* REPLACE (f{levels}.g AS i, 0 AS g), s{levels}.h AS subroot FROM f{levels} JOIN s{levels} ON f{levels}.g = s{levels}.g)""")
    for k in range(levels + 1, levels + 1 + source_levels):
        first = k == levels + 1
        steps.append(level(k, "t" if first else f"s{k}", "f" if first else f"f{k}", "f.g"))
    last = levels + 1 + source_levels
    steps.append(f"""
SELECT doc_id, leaf, subroot, s{last}.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = s{last}.h AS verified FROM f{last} CROSS JOIN s{last}
""")
    return "".join(steps)
