"""Session builder and the shared intermediate folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "clueforge", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow transfer; `conf` overrides by option name with `__` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or a private one where it is unset and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clueforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back.

    Cuts the lineage without depending on any executor's memory or disk: a task
    that is lost later reads the files again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clueforge/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches of this session have at most so many rows, so that those of whole texts stay small in the JVM and in every Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


#: Tables with fewer bytes (as stored) for each core than this are spread over the cores; larger ones have row groups enough.
SPREAD_BELOW = 16_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table for work that costs much more than a scan, spread over the cores if its files give them too few pieces."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BELOW * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
