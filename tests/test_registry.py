"""Every registered query of the engine's own operators against its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from webloom.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_partitions_do_not_matter(spark):
    from webloom.operators import pages

    df = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    one, many = pages.links(df.coalesce(1)), pages.links(df.repartition(7))
    assert rows(one.columns, map(tuple, one.collect())) == rows(many.columns, map(tuple, many.collect()))
