"""Sources with a cursor: of each key, only what lies beyond its high-water mark comes out, across restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: The store that keeps typed state of stateful processors; versions lie in the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HighWater(StatefulProcessor):
    """Lets rows pass whose `id` exceeds the greatest one of their key in all earlier batches, each id once, in order."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.mark.get()[0] if self.mark.exists() else 0
        greatest = last
        seen: set[int] = set()  # ids of this key in this batch
        for part in rows:
            fresh = part[part["id"] > last].drop_duplicates("id")
            fresh = fresh[~fresh["id"].isin(seen)]
            if len(fresh):
                seen.update(fresh["id"].tolist())
                greatest = max(greatest, int(fresh["id"].max()))
                yield fresh[self.columns]
        if greatest > last:
            self.mark.update((greatest,))

    def close(self) -> None:
        pass


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """While a query starts, state goes to a store that stateful processors can use."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def beyond_cursor(rows: DataFrame, key: Column, id: Column) -> DataFrame:
    """The rows of a stream whose id is beyond their key's cursor: key, id and the other columns.

    A cursor starts at 0, so ids up to 0 and null ones stay out, as do rows without
    a key and late rows with lower ids. Of rows of one batch with one key and id,
    one comes out. The state is one number a key.
    """
    named = rows.withColumns({"key": key.cast("string"), "id": id.cast("long")}).where("key is not null and id > 0")
    schema = StructType(named.schema.fields)
    return named.groupBy("key").transformWithStateInPandas(HighWater(named.columns), outputStructType=schema, outputMode="append", timeMode="none")


def collect_new(stream: DataFrame, place: str) -> int:
    """Run a stream with cursors over all that has landed, and append what is new to the table under `place`.

    The cursors and the list of written files lie in the shared folder too, so a
    run after a failure, or on more files, goes on where the last one ended and
    writes nothing twice. Returns how many rows there are now.
    """
    spark = stream.sparkSession
    with typed_state(spark):
        query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return collected(spark, stream.schema, place).count()


def collected(spark: SparkSession, schema: StructType, place: str) -> DataFrame:
    """What earlier runs have collected under `place`."""
    return spark.read.schema(schema).parquet(f"{place}/rows")


def chat_messages(landed: DataFrame) -> DataFrame:
    """Messages of landed conversation files (conv_id, turn, role, text) as cursor rows: the turn, from 1, is the message's id."""
    return beyond_cursor(landed.select("conv_id", "turn", "role", "text"), F.col("conv_id"), F.col("turn") + 1)


def search_results(landed: DataFrame, query: str, id: str) -> DataFrame:
    """Results of searches by query; cursors go by a digest of the query's text, so that it is not stored itself."""
    return beyond_cursor(landed, F.substring(F.sha2(F.col(query), 256), 1, 16), F.col(id))
