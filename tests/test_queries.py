"""Every query of the catalog against its SQL, and the driver's entry points."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from lexweave import catalog


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def _rows(cols, rows):
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = _rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        said = duck.execute(catalog.ORACLE_SQL[name])
        cols = [x[0] for x in said.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == _rows(cols, said.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_document_topics_rounds_halves_like_its_sql(spark, duck, tmp_path):
    amounts = [8336.71, 4103.15, 2072.91, 8336.05, -8336.71, 0.02, -0.02, 0.01, -999.99, 0.0, 1.7e308, float("nan"), float("inf"), None]
    rows = [(c, c % 25, amounts[(c - 1) % len(amounts)]) for c in range(1, 8 * len(amounts))]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = catalog.QUERIES["document_topics"](spark, str(tmp_path)).collect()
    want = con.execute(catalog.ORACLE_SQL["document_topics"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
