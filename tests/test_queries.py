"""Every registered query runs; those with SQL equal DuckDB's answer on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairloom.plans import catalogue

NAMES = list(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, int):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    d = entry.queries()[name](spark, sf_dir)
    columns = sorted(d.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in d.collect()), key=key)
    if name not in entry.oracle_sql():
        return
    res = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['pairloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and not [q for q in e.queries() if q[1].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
