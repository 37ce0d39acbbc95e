from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from oracle_check import TABLES, rows
from sheaf import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    cur = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns) and got == rows(columns, cur.fetchall())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for f in ("__spark_entry__.py", "oracle_check.py"):
        shutil.copy(ROOT / f, tmp_path)
    shutil.copytree(ROOT / "sheaf", tmp_path / "sheaf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_links' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_missing_package_takes_only_what_needs_it(tmp_path):
    for f in ("__spark_entry__.py", "oracle_check.py"):
        shutil.copy(ROOT / f, tmp_path)
    shutil.copytree(ROOT / "sheaf", tmp_path / "sheaf", ignore=shutil.ignore_patterns("__pycache__"))
    if not (tmp_path / "sheaf/llm").exists():
        pytest.skip("there is nothing that needs it")
    code = "import sys; sys.modules['ahocorasick'] = {}; import __spark_entry__ as e; q = e.queries(); assert 'graph_links' in q and 'pipeline' not in q; assert any(n.startswith('op') for n in q) == {}; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code.format("None", False)], cwd=tmp_path, check=True)
    subprocess.run([sys.executable, "-W", "ignore", "-c", code.replace("sys.modules['ahocorasick'] = {}; ", "").format(True)], cwd=tmp_path, check=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "sheaf").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
