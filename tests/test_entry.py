from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gritstone import catalogue

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    want = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    at = [want.columns.index(c) for c in cols]
    have = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert have == sorted(tuple(norm(r[k]) for k in at) for r in want.fetchall())
    assert have


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
