"""Every registered query of the operations against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lumenframe import engine_queries, queries

assert engine_queries
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(x) else repr(round(float(x), 8) + 0.0)
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    want = oracle.sql(queries.ORACLES[name])
    names = list(want.columns)
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(map(norm, r)) for r in want.fetchall())
    assert sorted(tuple(norm(r[n]) for n in names) for r in rows) == expected


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_registration_without_the_corpus_operators(tmp_path):
    """A copy of the repository without them registers all other queries, whether the pipeline's file is left or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for left in ([], ["corpus_pipeline.py"]):
        at = tmp_path / f"copy{len(left)}"
        shutil.copytree(f"{root}/lumenframe", at / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", *left]:
            if os.path.exists(f"{root}/{name}"):
                shutil.copy(f"{root}/{name}", at)
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True, check=True)
        assert set(said.stdout.split()) == set(queries.QUERIES)
