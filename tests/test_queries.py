"""Every registered query outside of the training-data operators against its oracle, and the repository's own rules."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in sorted(df.columns))} FROM ({ORACLE[name]})").fetchall())
        assert got == want


def test_nothing_outside_imports_the_training_data_operators():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"tidemark\.llm|from \.+llm|import llm", p.read_text()), p


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("hidden", ["public_tokenizers", "corpus_pipeline", "tidemark.llm"])
def test_entry_imports_without_optional_modules(hidden):
    code = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
names = set(e.queries())
assert "flagship_rank_ic" in names and set(e.oracle_sql()) <= names and "pipeline" not in names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
