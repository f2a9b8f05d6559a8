"""Registered queries against their DuckDB oracle on the smallest shared tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerspark.plans.catalog import load_all

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
PAIRS = sorted(n for n, q in load_all().items() if q.sql is not None)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "date") and callable(v.date) and not isinstance(v, str):
        try:
            return v.date()
        except TypeError:
            return v
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", PAIRS)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = sorted(tuple(str(_norm(r[c])) for c in cols) for r in sdf.collect())
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted(tuple(str(_norm(row[i])) for i in idx) for row in res.fetchall())
    assert got == exp


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["transaction_date", "currency", "exchange_rate", "is_imputed"]
    assert df.count() > 0


def test_every_query_names_its_items():
    assert len(load_all()) >= 100
    for q in load_all().values():
        assert q.items.strip()


def test_registry_loads_without_sparks_jars(monkeypatch):
    """Building the registry opens no file of the Spark installation and starts no JVM."""
    import subprocess
    import sys
    code = ("import glob, sys, zipfile; glob.glob = lambda *a, **k: []\n"
            "def no(*a, **k): raise OSError('hidden')\n"
            "zipfile.ZipFile = no\n"
            "import __spark_entry__ as e; from pyspark import SparkContext\n"
            "assert len(e.queries()) >= 100 and e.oracle_sql() and SparkContext._gateway is None")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
