"""State that survives runs: each micro-batch is merged into a keyed table by associative aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueforge.sources.landing import scratch


def merged_state(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], keys: list[str], values: dict[str, str]) -> DataFrame:
    """Run a stream over all there is; its state is prepare(batch) merged by `keys`.

    `values` names an associative aggregate (sum, min, max) for each other column.
    State versions are named by the batch, in a folder that the checkpoint lies in
    too, so a batch that is repeated after a failure writes its version anew and
    nothing counts twice. Returns the last version; without any batch it is empty.
    """
    spark = stream.sparkSession
    place = scratch(spark, "state")
    schema = {}

    def merge(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).select(*keys, *values)
        schema["of"] = rows.schema
        if number > 0:
            rows = spark.read.schema(rows.schema).parquet(f"{place}/version-{number - 1}").unionByName(rows)
        state = rows.groupBy(*keys).agg(*[getattr(F, how)(c).alias(c) for c, how in values.items()])
        state.write.mode("overwrite").parquet(f"{place}/version-{number}")
        schema["last"] = number

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if "last" not in schema:
        return prepare(spark.createDataFrame([], stream.schema)).select(*keys, *values).limit(0)
    return spark.read.schema(schema["of"]).parquet(f"{place}/version-{schema['last']}")
