"""Streaming queries: `events` replayed as a file stream, with SQL of the batch equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.registry import register
from clueforge.session import table
from clueforge.streaming import streams as S

_BUCKET = "(floor(epoch(ts) / {size}) * {size})::BIGINT"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since a stream takes a plain path for a folder of files.
    return S.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parque[t]")


def _name() -> str:
    return f"stream_{uuid.uuid4().hex}"


@register("st_tumbling", f"SELECT {_BUCKET.format(size=86400)} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.tumbling(_events(spark, sf_dir)), _name())
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


@register("st_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([d, d - 86400]) AS start FROM (SELECT event_type, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS d FROM events)) GROUP BY 1, 2")
def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.sliding(_events(spark, sf_dir)), _name())
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


@register("st_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM k GROUP BY user_id, session""")
def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.sessions(_events(spark, sf_dir)), _name())
    return out.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


@register("st_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.deduplicated(_events(spark, sf_dir), keys=("event_id", "event_type")).select("event_id", "event_type"), _name(), "append")
    return out.groupBy("event_type").agg(F.count("event_id").alias("n"))


@register("st_static_join", "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def st_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.drain(S.enriched(_events(spark, sf_dir), static, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n")), _name())


@register("st_48h", """WITH p AS (SELECT a.user_id, a.event_id, bool_or(b.event_id IS NOT NULL) AS near FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND (b.ts, b.event_id) < (a.ts, a.event_id) AND epoch(a.ts) - epoch(b.ts) <= 172800 GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (near) AS n FROM p GROUP BY 1""")
def st_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.corroborated(_events(spark, sf_dir)), _name(), "update")
    return out.groupBy("user_id").agg(F.sum("n").alias("n"))
