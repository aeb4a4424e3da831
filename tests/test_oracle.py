"""Every registered query against its DuckDB oracle (row count, column
names, order-insensitive values) on the smallest scale factor."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as ent
from conftest import SF_SMALL
from trendloom.plans.catalog import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
BASE = set(all_queries())
QUERIES = {k: v for k, v in ent.queries().items() if k in BASE}
ORACLE = {k: v for k, v in ent.oracle_sql().items() if k in BASE}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return str(v.tolist())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.columns == ["rank", "term", "n", "rel"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
