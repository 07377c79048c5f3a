from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weftline.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{f'{path}/*.parquet' if path.is_dir() else path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_and_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        want = con.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def listed(folder, code=""):
    """The number of queries that the entry lists in a folder, in another process."""
    code += "\nimport __spark_entry__ as e, sys; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return int(run.stdout.split()[-1])


def copied(folder, *without):
    shutil.copytree(ROOT / "weftline", folder / "weftline", ignore=shutil.ignore_patterns("__pycache__", *without))
    shutil.copy(ROOT / "__spark_entry__.py", folder)


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the llm folders and the pipeline are gone."""
    copied(tmp_path, "llm")
    assert listed(tmp_path) == len(QUERIES)


def test_entry_with_a_left_over_folder(tmp_path):
    copied(tmp_path, "llm")
    (tmp_path / "weftline" / "llm" / "__pycache__").mkdir(parents=True)
    assert listed(tmp_path) == len(QUERIES)


@pytest.mark.skipif(not (ROOT / "weftline" / "llm").exists(), reason="the corpus operators aren't here")
@pytest.mark.parametrize("name", ["xxhash", "zstandard"])
def test_entry_without_a_library(tmp_path, name):
    copied(tmp_path)
    assert listed(tmp_path, f"import sys; sys.modules[{name!r}] = None") == len(QUERIES)
