"""Evaluation of entities, clues, runs and packs against gold rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1 from counts; 0 where there is nothing to divide by."""
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    return {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)}


def entity_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """trace_id, tp, fp, fn of entities (trace_id, entity_type, value): each expected one, in order, takes the first actual one left that fits.

    Types fit if equal, or if the expected one is empty or `*`; values if one holds
    the other. Repeated entities of a record count once. A record's entities are one group.
    """
    key = expected.schema["trace_id"].dataType.simpleString()
    both = expected.select("trace_id", "entity_type", "value", F.lit(0).alias("side")).unionByName(actual.select("trace_id", "entity_type", "value", F.lit(1).alias("side"))).distinct()

    def counted(table: pa.Table) -> pa.Table:
        rows = sorted((r["side"], r["entity_type"] or "", r["value"] or "") for r in table.to_pylist())
        left = [r[1:] for r in rows if r[0] == 1]
        tp = fn = 0
        for _, kind, value in (r for r in rows if r[0] == 0):
            fits = next((a for a in left if (kind in ("", "*") or kind == a[0]) and (value == a[1] or (value and a[1] and (value in a[1] or a[1] in value)))), None)
            if fits is None:
                fn += 1
            else:
                left.remove(fits)
                tp += 1
        return pa.table({"trace_id": table.column("trace_id").slice(0, 1), "tp": pa.array([tp], pa.int64()), "fp": pa.array([len(left)], pa.int64()), "fn": pa.array([fn], pa.int64())})

    return both.groupBy("trace_id").applyInArrow(counted, f"trace_id {key}, tp long, fp long, fn long")


def clue_layers(expected: DataFrame, actual: DataFrame, n_records: int) -> DataFrame:
    """For the layers overall, standard and graph: counts of clue types, over-generation and duplicates. expected: clue_type, n; actual: clue_type, key."""
    graph = lambda c: F.col(c).startswith("entity_graph")
    layered = lambda df: df.withColumn("layer", F.explode(F.array(F.lit("overall"), F.when(graph("clue_type"), "graph").otherwise("standard"))))
    want = layered(expected).groupBy("layer").agg(F.collect_set("clue_type").alias("wanted"), F.sum("n").alias("expected"))
    got = layered(actual).groupBy("layer").agg(F.collect_set("clue_type").alias("found"), F.count("*").alias("actual"), F.countDistinct("clue_type", "key").alias("distinct"))
    df = want.join(got, "layer", "full").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("wanted", "found")} | {c: F.coalesce(c, F.lit(0)) for c in ("expected", "actual", "distinct")})
    tp = F.size(F.array_intersect("wanted", "found"))
    df = df.withColumns({"tp": tp.cast("long"), "fp": (F.size(F.array_except("found", "wanted")) + F.greatest(F.lit(0), F.col("actual") - F.greatest("expected", tp))).cast("long"), "fn": (F.size(F.array_except("wanted", "found")) + F.greatest(F.lit(0), F.col("expected") - F.col("actual"))).cast("long")})
    df = df.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return df.select("layer", "tp", "fp", "fn", "precision", "recall", "f1", F.round(F.col("actual") / F.greatest("expected", F.lit(1)), 4).alias("overgeneration"), F.round(F.col("actual") * 100 / max(1, n_records), 4).alias("per_hundred"), F.round(1 - F.col("distinct") / F.greatest("actual", F.lit(1)), 4).alias("duplicate_rate"))


def gains(base: DataFrame, run: DataFrame) -> DataFrame:
    """Differences of metrics (metric, value) of two reports; a metric of one report only has none."""
    a, b = base.select("metric", F.col("value").alias("before")), run.select("metric", F.col("value").alias("after"))
    return a.join(b, "metric", "full").withColumn("gain", F.round(F.col("after") - F.col("before"), 4))


def text_match(found: Column, gold: Column) -> dict[str, Column]:
    """Whether two texts are equal, and the share of characters that agree by edit distance."""
    longest = F.greatest(F.length(found), F.length(gold), F.lit(1))
    return {"exact": F.coalesce(found == gold, F.lit(False)), "characters": F.round(F.coalesce(1 - F.levenshtein(found, gold) / longest, F.lit(0.0)), 4)}


def overlay(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """What accepted terms (term, plain, seq) change in a dictionary (term, plain): the first of each term counts; status added, same, conflict; repeats of a term are counted."""
    first = fresh.groupBy("term").agg(F.min_by("plain", "seq").alias("plain"), (F.count("*") - 1).alias("repeats"))
    df = first.join(base.select("term", F.col("plain").alias("known")), "term", "left")
    return df.withColumn("status", F.when(F.col("known").isNull(), "added").when(F.col("known") == F.col("plain"), "same").otherwise("conflict"))
