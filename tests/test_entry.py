import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from calyxa.catalog import QUERIES
from calyxa.oracle import ORACLE_SQL

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
DATA = "/root/testdata/sf0.001"


def test_every_query_of_the_engine_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["o_orderkey", "o_custkey", "o_totalprice"]


@pytest.mark.skipif(not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="no test data or no DuckDB here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(None if x is None else round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in r) for r in rows), key=str)
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(want)


def _copy(tmp_path, *without):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".hypothesis", ".pytest_cache", *without))
    return copy


def _python(copy, *args):
    return subprocess.run([sys.executable, *args], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)


_COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"


def test_stands_without_the_training_data_part(tmp_path):
    """The driver deletes the two llm folders; corpus_pipeline.py may stay and can't be imported then."""
    copy = _copy(tmp_path, "llm")
    done = _python(copy, "-c", _COUNT)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == len(QUERIES), done.stderr[-500:]
    done = _python(copy, "-m", "pytest", "-q", "-x", "tests/test_sources.py", "tests/test_query.py")
    assert done.returncode == 0, done.stdout[-500:]


def test_stands_where_a_package_is_missing(tmp_path):
    block = "import sys; sys.modules['sentencepiece'] = None; "
    done = _python(_copy(tmp_path, "tests"), "-c", block + _COUNT)
    assert done.returncode == 0 and len(QUERIES) <= int(done.stdout.split()[-1]), done.stderr[-500:]
