"""Global order: row numbers, corroboration and circular distances against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clueforge.operators import clues as C
from clueforge.operators import ordering as O


@pytest.mark.parametrize("n", [0, 1, 50, 3_000])
def test_numbered(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(n)]
    found, total = O.numbered(spark.createDataFrame(rows, "k int, id int").repartition(5), ["k", "id"])
    assert total == n
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.id) for r in sorted(found.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in found.collect()) == list(range(n))


def brute(left, right, size):
    out = []
    for i, source, s in left:
        near = [(((t, j) < (s, i)), t, j) for j, other, t in right if other != source and abs(t - s) <= size and j != i]
        if near:
            _, t, j = min(near)
            out.append((i, j, abs(t - s) // 60))
    return sorted(out)


@pytest.mark.parametrize(("n", "sources", "times"), [(0, 1, 10), (1, 1, 10), (40, 1, 50), (300, 2, 10), (400, 3, 4_000), (400, 9, 200)])
def test_corroborated(spark, n, sources, times):
    rng = random.Random(n * sources)
    row = lambda i: (i, f"s{min(rng.randrange(sources), rng.randrange(sources))}", rng.randrange(times) * 977)
    pool = [row(i) for i in range(n + n // 3)]
    left, right = pool[:n], pool[n // 3 :]
    frame = lambda rows: spark.createDataFrame([*rows, (-1, None, 5), (-2, "s1", None)], "id long, source string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for a, b in ((left, right), (left, left)):
        found = C.corroborated(frame(a), frame(b))
        assert sorted((r.a_id, r.b_id, r.minutes) for r in found.collect()) == brute(a, b, 48 * 3600)


@pytest.mark.parametrize("times", [10, 300])
def test_order_distances(spark, times):
    rng = random.Random(times)
    rows = [(i, f"s{rng.randrange(3)}", rng.randrange(times) * 3_001) for i in range(200)]
    place = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    want = []
    for i, source, s in rows:
        near = [((place[j] - place[i]) % 200 or 200, j, abs(t - s) // 60) for j, other, t in rows if other != source and abs(t - s) <= 48 * 3600]
        if near:
            distance, j, minutes = min(near)
            want.append((i, j, distance, minutes))
    df = spark.createDataFrame(rows, "id long, source string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(map(tuple, C.order_distances(df).collect())) == sorted(want)


def test_no_stage_has_all_rows_in_one_task(spark):
    """A range holds a share of the rows, also where all have one time and one source."""
    df = spark.range(20_000).select(F.col("id"), F.lit("s").alias("source"), F.timestamp_seconds(F.lit(7)).alias("ts"))
    kept = O.ranged(df.repartition(8), [F.unix_seconds("ts"), "id"])
    assert max(r[1] for r in kept.groupBy("_part").count().collect()) < 12_000
