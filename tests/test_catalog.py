"""Every query of the catalog against its SQL in DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from plexus import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def compare(spark, duck, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    mine = Counter(tuple(map(str, r)) for r in frame.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(tuple(map(str, r)) for r in duck.sql(f"select {quoted} from ({sql})").fetchall())
    assert mine == theirs


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)


def test_entry_point_needs_no_corpus_operators(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
