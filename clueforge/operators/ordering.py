"""Global order without a task that holds all rows: row numbers, and the next row of another source."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clueforge.session import materialise


def ranges(rows: DataFrame) -> int:
    """How many ranges rows are cut in: as many as a shuffle has partitions, so that small rows keep all cores busy too."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, order: list[Column | str], name: str = "ranged") -> DataFrame:
    """`rows` sorted over all partitions and stored, with _part and _at: the range, and a number that grows along the order."""
    kept = rows.repartitionByRange(ranges(rows), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialise(kept, name).withColumn("_part", F.shiftright("_at", 33))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place") -> tuple[DataFrame, int]:
    """`rows` with their place (from 0) in the whole order, and how many there are.

    Ranges are sorted each by itself, and the sizes of those before are added: a
    number for each range is all the driver sees. Of ties, any may come first.
    """
    kept = ranged(rows, order)
    sizes = sorted(kept.groupBy("_part").agg(F.count("*"), F.min("_at")).collect())
    before = [0, *accumulate(n for _, n, _ in sizes)]
    starts = rows.sparkSession.createDataFrame([(part, first - b) for (part, _, first), b in zip(sizes, before[:-1], strict=True)], "_part long, _start long")
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_part", "_start"), before[-1]


def next_answers(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Adds `found` to the questions among `rows`: the next answer in the order whose source is another.

    `rows` has kind (1 for an answer), source, and answer, a struct with the
    answer's own source; the answers themselves are left out of the result. Each
    range looks within itself, as no hot time or source fills one; what the ranges
    after it begin with (a first answer, and the first one after it of another
    source) is handed to it.
    """
    kept = ranged(rows, order, "answers").repartition(ranges(rows), "_part")
    back = Window.partitionBy("_part").orderBy(F.desc("_at"))
    earlier, here = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    is_answer = F.col("kind") == 1
    kept = kept.withColumn("_next", F.last(F.when(is_answer, F.col("answer")), ignorenulls=True).over(earlier))
    # The first answer after a run of answers of one source.
    kept = kept.withColumn("_turn", F.last(F.when(is_answer & (F.col("_next.source") != F.col("answer.source")), F.col("_next")), ignorenulls=True).over(here))
    kept = kept.withColumn("_after", F.last(F.when(is_answer, F.struct(F.col("answer").alias("first"), F.col("_turn").alias("other"))), ignorenulls=True).over(earlier))
    kept = materialise(kept, "answers-near")
    # Of each range: its first answer, and the first one after it of another source.
    first = F.min_by(F.struct(F.col("answer").alias("first"), F.col("_turn").alias("other")), F.when(is_answer, F.col("_at")))
    summary = {r["_part"]: r["b"] for r in kept.groupBy("_part").agg(first.alias("b")).collect()}
    parts = sorted(summary)
    borders = {part: (b["first"], b["other"]) for part, b in summary.items() if b is not None}
    handed, ahead = [], None  # ahead: the first answer beyond a range and the one after it of another source
    for part in reversed(parts):
        handed.append((part, *(ahead or (None, None))))
        if part in borders:
            own, other = borders[part]
            if other is None and ahead is not None:
                other = ahead[0] if ahead[0]["source"] != own["source"] else ahead[1]
            ahead = (own, other)
    answer = rows.schema["answer"].dataType.simpleString()
    beyond = F.broadcast(rows.sparkSession.createDataFrame(handed, f"_part long, _first {answer}, _other {answer}"))
    outside = F.when(F.col("_first.source") != F.col("source"), F.col("_first")).otherwise(F.col("_other"))
    # The first answer of a range may end a run that goes on in the next.
    beyond_turn = F.when(F.col("_first.source") != F.col("_after.first.source"), F.col("_first")).otherwise(F.col("_other"))
    near = F.when(F.col("_after.first.source") != F.col("source"), F.col("_after.first")).otherwise(F.coalesce(F.col("_after.other"), beyond_turn))
    found = F.when(F.col("_after").isNotNull(), near).otherwise(outside)
    return kept.where(~is_answer).join(beyond, "_part", "left").withColumn("found", found).drop("_at", "_part", "_next", "_turn", "_after", "_first", "_other", "answer")
