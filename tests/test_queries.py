"""Every query of the catalog against DuckDB on the same tables, or for its rows where SQL can't express it."""

import duckdb
import pytest

from starloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (t[cols].sort_values(cols).reset_index(drop=True) for t in (got, want))
    for c in cols:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist())


def test_entry_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.queries()) <= set(e.queries())


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
