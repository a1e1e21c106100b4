"""Cursors over landed files and the buffer of waiting rows, across restarts."""

import random

from pyspark.sql import functions as F

from clueforge.streaming import cursors
from clueforge.streaming.pending import Pending

SCHEMA = "conv_id long, turn long, role string, text string"


def test_cursor_survives_restarts(spark, tmp_path):
    landed, place = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)

    def run():
        cursors.collect_new(cursors.chat_messages(spark.readStream.schema(SCHEMA).parquet(landed)), place)
        out = cursors.collected(spark, cursors.chat_messages(spark.readStream.schema(SCHEMA).parquet(landed)).schema, place)
        return sorted((r.conv_id, r.id, r.text) for r in out.collect())

    land((1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (2, 4, "user", "c"), (None, 3, "user", "no key"), (3, -1, "user", "no id"), (3, None, "user", "no id"))
    first = [(1, 1, "a"), (1, 2, "b"), (2, 5, "c")]
    assert run() == first
    assert run() == first  # nothing new has landed
    land((1, 1, "user", "again"), (2, 2, "user", "late"), (1, 2, "user", "d"), (4, 0, None, None))
    assert run() == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 5, "c"), (4, 1, None)]
    land((2, 9, "user", "e"), (2, 7, "user", "f"))
    assert [r for r in run() if r[0] == 2] == [(2, 5, "c"), (2, 8, "f"), (2, 10, "e")]


def test_search_cursors_do_not_hold_the_query(spark, tmp_path):
    landed, place = str(tmp_path / "landed"), str(tmp_path / "out")
    spark.createDataFrame([("q one", 5), ("q two", 3), ("q one", 4), (None, 1)], "q string, id long").write.parquet(landed)
    stream = cursors.search_results(spark.readStream.schema("q string, id long").parquet(landed), "q", "id").drop("q")
    assert cursors.collect_new(stream, place) == 3
    import hashlib

    keys = {hashlib.sha256(q.encode()).hexdigest()[:16] for q in ("q one", "q two")}
    assert {r.key for r in cursors.collected(spark, stream.schema, place).collect()} == keys


class Plain:
    def __init__(self):
        self.rows = {}

    def add(self, rows):
        for r in rows:
            if r[0] and r[0].strip():
                self.rows[r[0]] = r

    def drain(self, limit):
        keys = list(self.rows)[: None if limit is None else max(0, limit)]
        return [self.rows.pop(k) for k in keys]


def test_pending_rows_come_out_once(spark, tmp_path):
    rng = random.Random(3)
    buffer, plain, n = Pending(spark, str(tmp_path / "p"), "trace string, text string, at long", "trace"), Plain(), 0
    assert buffer.drained().count() == 0 and buffer.waiting().count() == 0
    for size, limit in ((12, 3), (0, 2), (9, 0), (7, 5), (3, None)):
        batch = []
        for _ in range(size):
            n += 1
            batch.append((rng.choice([None, " ", *[f"t{i}" for i in range(10)]]), f"v{n}", n))
        shuffled = rng.sample(batch, len(batch))
        buffer = Pending(spark, str(tmp_path / "p"), "trace string, text string, at long", "trace")  # another run
        plain.add(batch)
        assert buffer.add(spark.createDataFrame(shuffled, "trace string, text string, at long"), ["at"]) == len(plain.rows)
        assert sorted(map(tuple, buffer.drain(limit).collect())) == sorted(plain.drain(limit))
        assert {r.trace for r in buffer.waiting().collect()} == set(plain.rows)
    assert buffer.waiting().count() == 0


def test_a_change_without_its_mark_changes_nothing(spark, tmp_path, monkeypatch):
    buffer = Pending(spark, str(tmp_path / "p"), "trace string, at long", "trace")
    buffer.add(spark.createDataFrame([("a", 1), ("b", 2)], "trace string, at long"), ["at"])
    kept = Pending._commit
    monkeypatch.setattr(Pending, "_commit", lambda self, n, waiting, drained=None: waiting.write.parquet(f"{self.place}/waiting/lost"))
    buffer.drain(1)
    monkeypatch.setattr(Pending, "_commit", kept)
    assert buffer.waiting().count() == 2 and buffer.drained().count() == 0
    assert [r.trace for r in buffer.drain(1).collect()] == ["a"] and [r.trace for r in buffer.drain(5).collect()] == ["b"]
    assert buffer.drained().agg(F.count("*")).first()[0] == 2


def test_all_runs_at_once_are_those_of_repeated_drains(spark, tmp_path):
    schema = "trace string, at long"
    rows = [(f"t{i * 7 % 23}", i) for i in range(40)]
    one, all_runs = (Pending(spark, str(tmp_path / p), schema, "trace") for p in "ab")
    for buffer in (one, all_runs):
        buffer.add(spark.createDataFrame(rows, schema), ["at"])
    while one.waiting().count():
        one.drain(5)
    expected = sorted(map(tuple, one.drained().collect()))
    assert sorted(map(tuple, all_runs.drain_all(5).collect())) == expected
    assert all_runs.waiting().count() == 0 and len({r for *_, r in expected}) == 5
    for buffer in (one, all_runs):  # later rows have later runs
        buffer.add(spark.createDataFrame([("late", 99)], schema), ["at"])
        assert [r.trace for r in buffer.drain(5).collect()] == ["late"]
    assert sorted(map(tuple, all_runs.drained().collect())) == sorted(map(tuple, one.drained().collect()))
    assert all_runs.drain_all(5).count() == 0


def test_pending_query_drains_in_few_jobs(spark, sf, tmp_path):
    from clueforge import registry

    spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "ts", "event_id AS user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    spark.sparkContext.setJobGroup("pending", "pending")
    got = registry.queries()["st_pending_batch"](spark, str(tmp_path)).groupBy("build").count().collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pending")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.build for r in got) == list(range(-(-n // 60))) and sum(r["count"] for r in got) == n
