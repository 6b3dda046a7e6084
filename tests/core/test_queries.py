"""Every query with SQL against DuckDB on the smallest tables, and what SQL can't say against the given tables."""

import datetime
import glob
import os

import pytest

from tessera.plans import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, D)
    cur = duck.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted(([_plain(r[k]) for k in order] for r in cur.fetchall()), key=str)
    got = sorted(([_plain(r[c]) for c in sorted(columns)] for r in df.collect()), key=str)
    assert got == want


def test_chunks_are_those_of_the_index(spark):
    made = {r.chunk_id for r in queries.queries()["greedy_windows"](spark, D).select("chunk_id").collect()}
    given = {r.chunk_id for r in spark.read.parquet(f"{D}/index_chunks.parquet").select("chunk_id").distinct().collect()}
    assert len(given & made) >= 0.97 * len(given)  # the rest are stale chunks of earlier versions


def test_parsed_symbols_are_the_given_ones(spark):
    made = {tuple(r) for r in queries.queries()["parse_files"](spark, D).select("path", "symbol_name", "start_line", "end_line").collect()}
    given = {tuple(r) for r in spark.read.parquet(f"{D}/parsed_chunks.parquet").select("file_path", "symbol_name", "start_line", "end_line").distinct().collect()}
    assert len(given & made) >= 0.95 * len(given)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
