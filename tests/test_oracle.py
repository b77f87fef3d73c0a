"""Every query that has SQL against DuckDB over the smallest tables, and the entry point's contract."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return None
    return int(v) if isinstance(v, float) and v == int(v) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(str(cell(v)) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql(spark, name):
    """The whole query runs over the tables of the correctness run, where more of the dirt occurs; rows are written, so no column is pruned away."""
    df = entry.queries()[name](spark, LARGER)
    df.write.format("noop").mode("overwrite").save()
    columns = [c.lower() for c in df.columns]
    assert len(set(columns)) == len(columns) and not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A driver that has the repository on its path alone sends the package to its workers."""
    import subprocess
    import sys

    code = (
        f"import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r})\n"
        "from plenumspark.session import local_session\nimport __spark_entry__ as e\n"
        f"s = local_session('2', 2)\nprint('ROWS', e.queries()['p1_found'](s, {FOLDER!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in out.stdout, out.stderr[-800:]
