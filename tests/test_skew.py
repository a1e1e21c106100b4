"""Joins on hot keys against ordinary joins."""

from clueforge.operators import skew


def test_spread_join(spark):
    left = spark.createDataFrame([(1 if i % 2 else i % 7, i) for i in range(1_000)] + [(None, 5)] + [(99, i) for i in range(200)], "k long, x long")
    right = spark.createDataFrame([(i, i * 10) for i in range(6)], "k long, y long")
    assert {r.k for r in skew.hot_keys(left, "k").collect()} >= {1, 99}
    for how in ("left", "inner"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, skew.spread_join(left, right, "k", how).collect())) == want
    assert skew.spread_join(left.limit(0), right, "k").count() == 0
