"""Every registered query against its DuckDB SQL twin on the smallest tables
(the same comparison the correctness gate makes at sf0.01)."""

import datetime as dt
import math

import pytest

import __spark_entry__ as entry_mod
from feedloom.plans import catalog

from conftest import SF_SMALL

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(repr(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False, name=None)))


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(SQL) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    gc, gr = _table(got)
    wc, wr = _table(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["feed", "pos", "item_id", "anchor", "title", "item_no", "next_link"]
