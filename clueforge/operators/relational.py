"""Relational operators that recur in reports: latest rows, caps, quotas, samples and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.session import spread


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(row.alias("_row")).select(key, "_row.*")


def cap_by(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def round_robin(df: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """Adds `turn`, by which members of a group alternate."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group, member).orderBy(order)))


def quota_sample(df: DataFrame, source: str, cls: str, order: str, per_source: int, per_class: int) -> DataFrame:
    """At most `per_source` rows of each source, and then at most `per_class` of each class."""
    capped = cap_by(df, source, [F.col(order)], per_source)
    return cap_by(capped, cls, [F.col(order)], per_class)


def merge(pool: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Two sets of clues by key: sets united, scores at their highest. Columns: key, traces, score."""
    return pool.unionByName(fresh).groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("traces")))).alias("traces"), F.max("score").alias("score"))


def anti_union(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """`base` and the rows of `more` whose key it lacks."""
    return base.unionByName(more.join(base, key, "left_anti"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts by key with their share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def top_k_sparse(docs: DataFrame, query: list[tuple[str, float]], k: int) -> DataFrame:
    """Cosine of a query and texts over word counts. docs: doc_id (distinct), text; query: (token, weight).

    Dot product and norm of a text are one walk over its sorted words, in its own
    row: a scan, and the k best of each task.
    """
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("square"))

    def step(at, word):
        again = at["word"] == word
        return F.struct(word.alias("word"), F.when(again, at["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), (at["square"] + F.when(again, 2 * at["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("square"))

    words = spread(docs).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    some = words.where(F.arrays_overlap("words", F.array(*[F.lit(t) for t, _ in query])))
    times = lambda token: F.size(F.filter("words", lambda w: w == token))
    dot = sum((times(t) * weight for t, weight in query), F.lit(0.0))
    size = sum(w * w for _, w in query) ** 0.5
    scored = some.select("doc_id", dot.alias("dot"), F.sqrt(F.aggregate(F.array_sort("words"), start, step)["square"]).alias("norm"))
    return scored.select("doc_id", F.round(F.col("dot") / (F.col("norm") * size), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def within(df: DataFrame, key: str, trace: str, source: str, seconds: str, most: int) -> DataFrame:
    """Keys with two records and two sources or more whose times (seconds, null ones ignored) are at most `most` apart: key, n, sources, span."""
    found = df.groupBy(key).agg(F.countDistinct(trace).alias("n"), F.countDistinct(source).alias("sources"), (F.max(seconds) - F.min(seconds)).alias("span"))
    return found.where((F.col("n") >= 2) & (F.col("sources") >= 2) & (F.coalesce("span", F.lit(0)) <= most))


def within_hours(times: list[str], as_of: Column, hours: int) -> Column:
    """Whether the first time there is (seconds) is at most `hours` before `as_of`; a row without any stays."""
    at = F.coalesce(*[F.col(t) for t in times])
    return at.isNull() | (as_of - at <= hours * 3600)
