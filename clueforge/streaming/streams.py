"""Structured Streaming over observations: windows, late data, duplicates, joins and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clueforge.sources.landing import scratch


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The event files under `path` as a stream; times become instants in UTC.

    All files there are make one micro-batch, so no row is late and results don't
    depend on how a table is cut into files; `files` limits those of a batch.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, late: str = "2 days", size: str = "48 hours", step: str = "24 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, late: str = "2 days", gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str | None = None, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One row of each key. With `late` the state is bounded, and rows that come later than that are lost."""
    if late is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def enriched(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table."""
    return events.join(static, key, "left")


#: What is kept of a user: the last time of each event type, bounded by the number of types.
STATE = "types array<string>, times array<double>"


def corroborated(events: DataFrame, hours: int = 48) -> DataFrame:
    """For each user and batch how many events follow one of another type within `hours`.

    The state of a user is the last time of each type, so it does not grow with
    the stream. Within a batch events may come in any order; one that comes in a
    batch after a later event finds only what its state still holds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = dict(zip(*state.get, strict=True)) if state.exists else {}
        n = 0
        for row in pd.concat(list(batches)).sort_values(["s", "event_id"]).itertuples():
            n += any(t != row.event_type and 0 <= row.s - at <= hours * 3600 for t, at in last.items())
            last[row.event_type] = max(row.s, last.get(row.event_type, row.s))
        state.update((list(last), list(last.values())))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    rows = events.select("user_id", "event_id", "event_type", F.col("ts").cast("double").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", STATE, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is and return what its sink holds, a table in the shared folder; nothing of it passes the driver.

    A batch that is repeated after a failure writes its rows anew. In complete mode
    the last batch's rows are the result, in the others those of all batches.
    """
    spark = stream.sparkSession
    place = scratch(spark, name)
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch-{number}")
        numbers.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    last = sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*[f"{place}/batch-{n}" for n in (last[-1:] if mode == "complete" else last)])


def upsert(batch: DataFrame, target: DataFrame | None, key: list[str], order: str) -> DataFrame:
    """Last write wins: the target's and the batch's rows, the one of highest `order` for each key."""
    from clueforge.operators.relational import latest

    rows = batch if target is None else target.unionByName(batch)
    return latest(rows.withColumn("_key", F.struct(*key)), "_key", [order]).drop("_key")
