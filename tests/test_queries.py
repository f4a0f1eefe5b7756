"""Every query of the catalog against its SQL on the smallest tables, and the operators' edge cases."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from veedor import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLES:
        assert len(rows) > 0
        return
    want = duck.sql(catalog.ORACLES[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "veedor", tmp_path / "veedor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-2]) == len(catalog.QUERIES), out.stderr
