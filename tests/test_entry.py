"""The entry module: every query runs, its SQL agrees, and it works without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def normal(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return list(frame.columns), sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    assert normal(catalog.queries()[name](spark, DATA).toPandas()) == normal(con.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql(spark, name):
    """Two runs agree, nothing is null throughout, and where rows carry an id of documents they are whole documents."""
    first, again = (catalog.queries()[name](spark, DATA).toPandas() for _ in range(2))
    assert len(first) > 0
    assert normal(first) == normal(again)
    assert not first.isna().all().any()
    if "doc_id" in first and not first["doc_id"].duplicated().any() and len(first.columns) == 2 and "text" in first:
        assert len(first) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_optional_subpackage(tmp_path):
    for file in [ROOT / "__spark_entry__.py", *(ROOT / "textloom").rglob("*.py")]:
        if "llm" not in file.parts:
            to = tmp_path / file.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(file.read_bytes())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalog.queries())), "False"]
