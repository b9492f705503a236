from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from foliospark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_tables
@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = catalog.queries()[name](spark, SF)
    done = database.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(v) for v in r) for r in done.fetchall()), key=repr)


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for p in ("__spark_entry__.py", "foliospark"):
        subprocess.run(["cp", "-r", root / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "foliospark/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.llm is None and 'pipeline' not in e.queries() and 'closure' in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
