"""Rows that wait for a build: the last version of each key, in the order of first arrival, drained some at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.operators.ordering import numbered


class Pending:
    """A buffer of rows by key under `place`, in the shared folder, that survives runs.

    Each change writes the waiting rows anew beside the last version and then one
    mark that names it; a run that dies before its mark changes nothing, and the
    drained rows belong to the mark that took them out.
    """

    def __init__(self, spark: SparkSession, place: str, schema: str, key: str):
        self.spark, self.place, self.key = spark, place, key
        self.schema = f"{schema}, _batch long, _turn long"
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _marks(self) -> DataFrame:
        return self.spark.read.schema("n long, waiting string, drained string").parquet(f"{self.place}/marks")

    def _last(self) -> tuple[int, str | None]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/marks")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return 0, None
        row = self._marks().orderBy(F.desc("n")).first()
        return (row["n"], row["waiting"]) if row else (0, None)

    def _commit(self, n: int, waiting: DataFrame, drained: DataFrame | None = None) -> None:
        name = uuid.uuid4().hex
        waiting.write.parquet(f"{self.place}/waiting/{name}")
        if drained is not None:
            drained.write.parquet(f"{self.place}/drained/{name}")
        self.spark.createDataFrame([(n, name, name if drained is not None else None)], "n long, waiting string, drained string").coalesce(1).write.mode("append").parquet(f"{self.place}/marks")

    def waiting(self) -> DataFrame:
        """The rows that wait, with _batch and _turn: when their key first came."""
        _, name = self._last()
        return self.spark.read.schema(self.schema).parquet(f"{self.place}/waiting/{name}") if name else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, order: list[str]) -> int:
        """Add rows in `order`: the last row of a key stands, at the place of its first; rows without a key are left out. Returns how many wait."""
        n, _ = self._last()
        known = batch.where(F.col(self.key).isNotNull() & (F.trim(F.col(self.key).cast("string")) != ""))
        placed, _ = numbered(known.select(*self.columns), order, "_turn")
        fresh = placed.withColumn("_batch", F.lit(n + 1).cast("long"))
        rows = self.waiting().unionByName(fresh)
        at = F.struct("_batch", "_turn")
        merged = rows.groupBy(self.key).agg(F.min(at).alias("_first"), F.max_by(F.struct(*[c for c in self.columns if c != self.key]), at).alias("_row"))
        self._commit(n + 1, merged.select(self.key, "_row.*", F.col("_first._batch").alias("_batch"), F.col("_first._turn").alias("_turn")).select(*self.columns, "_batch", "_turn"))
        return self.waiting().count()

    def drain(self, limit: int | None = None) -> DataFrame:
        """Take the first `limit` rows (all, without one) out of the buffer; what remains waits on."""
        n, _ = self._last()
        rows = self.waiting()
        if limit is None:
            out, rest = rows, rows.limit(0)
        else:
            placed, _ = numbered(rows, ["_batch", "_turn"], "_place")
            out, rest = (placed.where(c).drop("_place") for c in (F.col("_place") < max(0, limit), F.col("_place") >= max(0, limit)))
        self._commit(n + 1, rest.select(*rows.columns), out.select(*rows.columns))
        return self.drained().where(F.col("run") == n + 1).drop("run")

    def drain_all(self, size: int) -> DataFrame:
        """Take all rows out in runs of `size` (1 or more) rows, as repeated drains would, in one change."""
        if size < 1:
            raise ValueError("a run takes one row or more")
        n, _ = self._last()
        placed, waiting = numbered(self.waiting(), ["_batch", "_turn"], "_place")
        runs = max(1, -(-waiting // size))
        # The change has the number of its last run; a row's run is told by how far it is before that.
        out = placed.withColumn("_run", F.floor(F.col("_place") / size).cast("long") - (runs - 1)).select(*self.columns, "_batch", "_turn", "_run")
        self._commit(n + runs, self.waiting().limit(0), out)
        return self.drained().where(F.col("run") > n)

    def drained(self) -> DataFrame:
        """All rows that were ever drained, with the number of their run."""
        marks = self._marks().where("drained is not null").select("n", "drained").collect() if self._last()[0] else []
        schema = f"{self.schema}, _run long"
        parts = [self.spark.read.schema(schema).parquet(f"{self.place}/drained/{r['drained']}").withColumn("run", F.lit(r["n"]) + F.coalesce("_run", F.lit(0)).cast("long")) for r in marks]
        out = self.spark.createDataFrame([], f"{schema}, run long")
        for part in parts:
            out = out.unionByName(part)
        return out.select(*self.columns, "run")
