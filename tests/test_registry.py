"""Driver contract: entry() runs, every query has an oracle unless documented,
and every query equals its DuckDB oracle on the sf0.001 tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from shelfscope.plans import catalog, oracle_sql
from shelfscope.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NO_ORACLE = {"page_card_offers", "page_json_offers"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"sku", "mediana_180d", "queda_real_percent", "menor_preco_historico"} <= set(df.columns)


def test_every_query_has_an_oracle():
    assert set(catalog.build()) - set(oracle_sql.build()) <= NO_ORACLE
    assert set(catalog.build()) <= set(E.queries()) and set(oracle_sql.build()) <= set(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sqls = oracle_sql.build()
    bad = []
    for name, fn in catalog.build().items():
        if name not in sqls:
            continue
        df = fn(spark, SF)
        cols = df.columns
        a = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
        cur = con.execute(sqls[name])
        dcols = [d[0] for d in cur.description]
        rows = cur.fetchall()
        idx = [dcols.index(c) for c in sorted(cols)] if sorted(dcols) == sorted(cols) else None
        if idx is None:
            bad.append((name, "columns"))
            continue
        b = sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)
        if a != b:
            bad.append((name, len(a), len(b)))
    assert not bad, bad
