"""Every table query at the smallest scale against its SQL, and the entry without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import plumbline.queries as core

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = core.QUERIES[name](spark, SF).toPandas()
    want = con.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want[list(got.columns)])


def test_entry_without_the_subpackage(tmp_path):
    """As the driver leaves it: no llm folder, no corpus_pipeline.py."""
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and 'filter_eq_float' in q and not any(k.startswith('op') for k in q); print('fine')"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert said.stdout.strip() == "fine", said.stderr


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
