"""Retrieval over a stored inverted index: a query reads the postings of its own terms, best bands first, and stops early."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clueforge.functions import text as T
from clueforge.sources.landing import scratch

#: The term under which every item is listed, so that items without a common term can be found too.
EVERY = ""

#: Width of a band of static scores, and the bands of the first read; each later read takes twice as many.
BAND, FIRST = 0.01, 2

#: What a common term, a wanted risk, a preferred source, several sources, quality and confidence add to a score, and how many terms count.
TERM, RISK, SOURCE, CROSS, QUALITY, CONFIDENCE, TERMS = 0.12, 0.35, 0.15, 0.2, 0.1, 0.08, 6


@dataclass(frozen=True)
class Index:
    """Postings under `path`, a folder for each band, sorted by term in each file; the greatest static score of each band."""

    spark: SparkSession
    path: str
    schema: str
    tops: tuple[tuple[int, float], ...]

    def postings(self, terms: Iterable[str], bands: Iterable[int]) -> DataFrame:
        """The postings of some terms in some bands; partitions and row groups of others are not read."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.where(F.col("band").isin(list(bands)) & F.col("token").isin(list(terms)))


def build_index(items: DataFrame, tokens: Column, static: Column) -> Index:
    """An index of items (id and other columns, which the postings repeat) by tokens, in bands of their static score.

    Files hold ranges of (term, id), so a term that all items share spreads over
    many. Items without a static score have 0. Nothing passes the driver but a
    number for each band.
    """
    spark = items.sparkSession
    rows = items.withColumn("static", F.coalesce(static, F.lit(0.0))).withColumn("band", F.floor(F.col("static") / BAND).cast("int"))
    listed = F.array_distinct(F.concat(F.array(F.lit(EVERY)), F.coalesce(tokens, F.array().cast("array<string>"))))
    path = scratch(spark, "index")
    posted = rows.withColumn("token", F.explode(listed)).repartitionByRange("band", "token", "id").sortWithinPartitions("band", "token", "id")
    posted.write.partitionBy("band").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posted.schema)
    stored = spark.read.schema(schema).parquet(path)
    tops = stored.where(F.col("token") == EVERY).groupBy("band").agg(F.max("static").alias("top")).collect()
    return Index(spark, path, schema, tuple(sorted(((r["band"], r["top"]) for r in tops), reverse=True)))


def clue_index(clues: DataFrame) -> Index:
    """An index of clues: id, clue_type, key, entities, sources, risk_category, quality, confidence, seen (seconds)."""
    text = F.concat_ws(" ", "clue_type", "key", F.array_join("entities", " "), F.array_join("sources", " "))
    least = lambda c: F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1.0))
    return build_index(clues, T.tokens(F.lower(text)), QUALITY * least("quality") + CONFIDENCE * least("confidence"))


def retrieve(index: Index, query_tokens: Iterable[str], limit: int = 50, risks: tuple[str, ...] = (), preferred: tuple[str, ...] = (), cross_source: bool = False, only_risks: tuple[str, ...] = (), only_sources: tuple[str, ...] = (), least_quality: float | None = None, as_of: int | None = None, hours: int | None = None, fallback: int = 10) -> DataFrame:
    """The items of highest score: id, score, overlap, stale, place; ties by quality, confidence, then id.

    Common terms, wanted risks, preferred sources and several sources add to the
    static score. Items that a filter rules out don't count; one that was last seen
    more than `hours` before `as_of` counts, as stale, if the window is wider than a
    day and it shares a term. Items with a positive score are returned up to `limit`;
    where there is none, the first `fallback`.

    Bands are read from the best one down, each read taking twice as many. An item's
    postings lie in one band, so scores are whole as soon as they are seen; when the
    `limit`-th score is beyond what any unread item could reach, the rest stays unread.
    """
    terms = tuple(dict.fromkeys(t for t in query_tokens if t))
    extra = TERM * min(len(terms), TERMS) + RISK * bool(risks) + SOURCE * bool(preferred) + CROSS * cross_source
    bands = [b for b, _ in index.tops]
    any_in = lambda column, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(column, F.lower(w)))
    risk, names = F.lower(F.coalesce("risk_category", F.lit(""))), F.lower(F.array_join("sources", " "))
    read, step = 0, FIRST
    while True:
        read = min(len(bands), read + step)
        step = read
        rows = index.postings([EVERY, *terms], bands[:read])
        kept = [c for c in rows.columns if c not in ("id", "token")]
        items = rows.groupBy("id").agg(F.count_if(F.col("token") != EVERY).alias("overlap"), *[F.first(c).alias(c) for c in kept])
        if least_quality is not None:
            items = items.where(F.coalesce("quality", F.lit(0.0)) >= least_quality)
        if only_risks:
            items = items.where(any_in(risk, only_risks))
        if only_sources:
            items = items.where(any_in(names, only_sources))
        stale = F.lit(False) if hours is None or as_of is None else F.coalesce(F.lit(as_of) - F.col("seen") > hours * 3600, F.lit(False))
        items = items.withColumn("stale", stale).where(~F.col("stale") | (F.lit((hours or 0) > 24) & (F.col("overlap") > 0)))
        score = TERM * F.least("overlap", F.lit(TERMS)) + F.col("static")
        score += F.when(any_in(risk, risks), RISK).otherwise(0.0) if risks else F.lit(0.0)
        score += F.when(any_in(names, preferred), SOURCE).otherwise(0.0) if preferred else F.lit(0.0)
        score += F.when(F.size(F.array_distinct("sources")) >= 2, CROSS).otherwise(0.0) if cross_source else F.lit(0.0)
        order = [F.desc("score"), F.desc_nulls_last("quality"), F.desc_nulls_last("confidence"), F.asc("id")]
        best = items.withColumn("score", F.round(score, 6)).orderBy(*order).limit(limit)
        top = best.select("id", "score", "overlap", "stale").collect()  # at most `limit` rows
        beyond = extra + index.tops[read][1] if read < len(bands) else float("-inf")
        if read >= len(bands) or len(top) == limit and top[-1]["score"] > beyond + 1e-6:
            break
    positive = [r for r in top if r["score"] > 0]
    out = positive if positive else top[: min(limit, fallback)]
    shape = f"id {dict(best.dtypes)['id']}, score double, overlap long, stale boolean, place int"
    return index.spark.createDataFrame([(*r, k + 1) for k, r in enumerate(out)], shape)


def word_index(records: DataFrame, tokens: Column) -> Index:
    """An index of records (id) by words, whose weights are their shares of a record's unit vector of counts."""
    words = records.select("id", F.explode(tokens).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    norm = words.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    spark = records.sparkSession
    path = scratch(spark, "words")
    posted = words.join(norm, "id").select("token", "id", "n", "norm", F.lit(0).alias("band")).repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    posted.write.partitionBy("band").parquet(path)
    return Index(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posted.schema), ((0, 1.0),))


def nearest(index: Index, query: dict[str, float], k: int) -> DataFrame:
    """id, score: the k records of a word index whose vectors lie nearest the query's words, ties to the lesser id."""
    rows = index.postings(query, [0])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in query.items() for x in kv]), F.col("token"))
    scored = rows.groupBy("id").agg((F.sum(F.col("n") * weight) / F.first("norm")).alias("score"))
    return scored.withColumn("score", F.round("score", 6)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
