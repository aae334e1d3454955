"""Every registered query against its SQL on the smallest tables, and the independence of the library from its optional part."""

from __future__ import annotations

import math
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["hash", "host", "others"]


def test_nothing_else_imports_the_optional_part():
    root = Path(entry.__file__).parent
    for p in (root / "tessella").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tessella\.llm|from tessella import llm|corpus_pipeline", p.read_text()), p
