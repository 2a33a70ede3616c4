"""The registry: importable without a session, and each query with SQL gives the rows of its SQL."""

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from engramic.plans import catalog

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 80"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of all queries with SQL; planning takes longer than running, so they run side by side."""
    known = registered.queries()

    def run(name):
        try:
            got = known[name](spark, DATA)
            return got.columns, [tuple(map(plain, r)) for r in got.collect()]
        except Exception as error:  # told by the query's own test
            return error, []

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(sorted(catalog.oracle_sql()), pool.map(run, sorted(catalog.oracle_sql())), strict=True))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(results, oracle, name):
    got, rows = results[name]
    assert not isinstance(got, Exception), got
    want = oracle.execute(registered.oracle_sql()[name])
    assert got == [c[0] for c in want.description]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
