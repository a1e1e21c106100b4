"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 2).

Training counts hashed 1- to 3-grams of labelled texts per language; the counts
are summed as packed arrays in two levels. The log-probability matrix (languages
x buckets, fixed-point int32, its size checked) is broadcast, and each batch is
scored in numpy by gathering each n-gram from the matrix and differences of
running sums. Sums of whole numbers are exact, so a score does not depend on
what else is in a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.llm._text import release, slices, utf8

#: Buckets of the hashed n-grams, orders of the n-grams, the most bytes of the broadcast matrix (976 languages), and the fixed-point unit of log probabilities.
BUCKETS, ORDERS, MATRIX_BYTES, UNIT = 1 << 16, (1, 2, 3), 256_000_000, 1 << 16

#: Bytes of text that are worked on at once: each takes up to about 50 bytes of a worker's memory.
SLICE = 250_000

UNDETERMINED = "und"

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all rows, and the n + 1 offsets of the rows."""
    texts = [x or "" for x in pc.utf8_lower(column).to_pylist()]
    marks = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=marks[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), marks


def ngram_buckets(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each position; the last order - 1 have none."""
    n = max(0, len(codes) - order + 1)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h ^= codes[k : k + n] * _ODD[k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(buckets - 1)


def _inside(marks: np.ndarray, order: int) -> np.ndarray:
    """The places at which an n-gram of a row begins that ends in the same row."""
    n = max(0, int(marks[-1]) - order + 1)
    ends = np.repeat(marks[1:], np.diff(marks))[:n]
    return np.flatnonzero(np.arange(n) + order <= ends)


def _counted(batches: Iterator[pa.RecordBatch], langs: list[str], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Packed bucket counts for each language of a partition."""
    from pyspark import TaskContext

    release()
    sums = np.zeros(len(langs) * buckets, np.int64)
    number = {x: i for i, x in enumerate(langs)}
    for batch in batches:
        for part in slices(batch, 1, SLICE):
            codes, marks = _codes(part.column(1))
            of_row = np.array([number[x] for x in part.column(0).to_pylist()], np.int64)
            owner = np.repeat(of_row, np.diff(marks))
            for order in ORDERS:
                at = _inside(marks, order)
                places, n = np.unique(owner[at] * buckets + ngram_buckets(codes, order, buckets)[at], return_counts=True)
                sums[places] += n
    used = np.flatnonzero(sums.reshape(len(langs), buckets).any(1))
    group = TaskContext.get().partitionId() % groups
    yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in used], pa.string()), pa.array([group] * len(used), pa.int32()), pa.array([zlib.compress(sums[i * buckets : (i + 1) * buckets].tobytes(), 1) for i in used], pa.binary())], names=["lang", "part", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for packed in table.column("counts").to_pylist():
        one = np.frombuffer(zlib.decompress(packed), np.int64)
        total = one.copy() if total is None else total + one
    return pa.table({"lang": table.column("lang")[:1], "part": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows_per_language: int | None = None, buckets: int = BUCKETS) -> dict:
    """Languages (sorted), their log priors and log probabilities in UNITs, from rows with non-null text and language.

    All rows are counted. More languages than fit the matrix raise an error. With
    `rows_per_language`, of a language with more rows than that, rows are taken by a
    hash of key and text at that rate, so rows that share a key are not taken or
    left together; priors are of all rows.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes) * buckets * 4 > MATRIX_BYTES:
        raise ValueError(f"{len(sizes)} languages don't fit the matrix of {MATRIX_BYTES} bytes; take fewer buckets")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "prior": np.zeros(0, np.int64), "matrix": np.zeros((0, buckets), np.int32), "buckets": buckets}
    taken = rows
    if rows_per_language is not None:
        rate = F.lit(1.0)
        for name in langs:
            if sizes[name] > rows_per_language:
                rate = F.when(F.col("lang") == name, F.lit(rows_per_language / sizes[name])).otherwise(rate)
        taken = rows.where(F.pmod(F.xxhash64(F.col("key").cast("string"), F.col("text")), F.lit(1 << 30)) < rate * (1 << 30))
    schema = "lang string, part int, counts binary"
    groups = 32
    packed = taken.select("lang", "text").mapInArrow(lambda it: _counted(it, langs, buckets, groups), schema).groupBy("lang", "part").applyInArrow(_summed, schema).groupBy("lang").applyInArrow(_summed, schema)
    matrix = np.full((len(langs), buckets), 1.0)
    for row in packed.collect():
        matrix[langs.index(row["lang"])] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    matrix = np.log(matrix / matrix.sum(1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    fixed = lambda x: np.rint(x * UNIT)
    return {"langs": langs, "prior": fixed(prior).astype(np.int64), "matrix": fixed(matrix).astype(np.int32), "buckets": buckets}


def predict(docs: DataFrame, model: dict, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns `keep` (of any names but the three below), lang_pred, score and fit of every row.

    The score is the posterior of the predicted language; `fit` is by how much
    (nats for each n-gram) that language explains the text better than equal
    chances of all buckets do. A text that is null or has no letter, or a model
    without languages, gives `und`, score 0 and fit null. Ties go to the first
    language by name. Texts of any length are scored whole. Repeated rows are
    scored each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model["langs"] else F.lit(False)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.when(letters, F.col(text)).alias("_body"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_body").schema) + "lang_pred string, score double, fit double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        langs, prior, matrix, buckets = (shared.value[k] for k in ("langs", "prior", "matrix", "buckets"))
        names = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, SLICE):
                column = part.column(part.num_columns - 1)
                valid = np.asarray(pc.is_valid(column))
                best, score, fit = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if langs:
                    codes, marks = _codes(column)
                    totals, grams = np.tile(prior, (part.num_rows, 1)), np.zeros(part.num_rows)
                    for order in ORDERS:
                        which = ngram_buckets(codes, order, buckets)
                        starts, ends = np.minimum(marks[:-1], len(which)), np.clip(marks[1:] - order + 1, 0, len(which))
                        full = np.flatnonzero(ends > starts)
                        grams[full] += ends[full] - starts[full]
                        for k in range(len(langs)):
                            run = np.zeros(len(which) + 1, np.int64)
                            np.cumsum(matrix[k][which], out=run[1:], dtype=np.int64)
                            totals[full, k] += run[ends[full]] - run[starts[full]]
                    top = totals.max(1)
                    best = np.where(valid, totals.argmax(1), best)
                    score = np.where(valid, 1 / np.exp((totals - top[:, None]) / UNIT).sum(1), 0.0)
                    fit = (top - prior[totals.argmax(1)]) / UNIT / np.maximum(grams, 1) + np.log(buckets)
                own = valid & bool(langs)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(fit, mask=~own)], names=[*part.schema.names[:-1], "lang_pred", "score", "fit"])

    return rows.mapInArrow(scored, schema)
