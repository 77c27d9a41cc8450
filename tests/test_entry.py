"""The driver's contract: every registered query of the area operators equals its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridfold.plans import oracles
from gridfold.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


def plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    found = engine.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(plain([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_input_order_does_not_matter(spark, monkeypatch):
    read = plans.V.read
    want = {n: sorted(map(plain, plans.queries()[n](spark, SF).collect())) for n in ("building_groups", "area_rank", "normalised_name_counts")}
    monkeypatch.setattr(plans.V, "read", lambda *a: read(*a).orderBy(plans.F.rand(3)).repartition(5))
    assert {n: sorted(map(plain, plans.queries()[n](spark, SF).collect())) for n in want} == want
