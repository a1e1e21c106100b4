"""Every registered query with SQL against DuckDB on the smallest tables, and the others for rows."""

import decimal
import os

import duckdb
import pytest

from clueforge import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(int(value)) if isinstance(value, decimal.Decimal) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, db, name):
    found = registry.queries()[name](spark, sf)
    cols = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(cols).collect())
    answer = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["st_dedup", "st_48h"])
def test_stream_of_files_out_of_time_order(spark, sf, tmp_path, name):
    events = tmp_path / "events.parquet"
    events.mkdir()
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE late AS SELECT *, row_number() OVER (ORDER BY ts DESC) AS place FROM '{sf}/events.parquet'")
    n = connection.execute("SELECT count(*) FROM late").fetchall()[0][0]
    for i in range(5):
        connection.execute(f"COPY (SELECT * EXCLUDE (place) FROM late WHERE place * 5 // {n + 1} = {i} ORDER BY place) TO '{events}/part-{i}.parquet'")
        os.utime(events / f"part-{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    found = registry.queries()[name](spark, str(tmp_path))
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/*.parquet'")
    answer = connection.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in answer.description]
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(answer.fetchall())


@pytest.mark.parametrize("name", ["st_dedup", "st_session"])
def test_stream_results_do_not_pass_the_driver(spark, sf, monkeypatch, name):
    written = []
    writer = type(spark.readStream.schema("a long").parquet(sf).writeStream)
    known = writer.format
    monkeypatch.setattr(writer, "format", lambda self, source: written.append(source) or known(self, source))
    assert registry.queries()[name](spark, sf).count() > 0
    assert "memory" not in written


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
