"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}{'/*' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["search_total"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderpriority" in plan and "o_totalprice" not in plan


def test_whole_queries_leave_out_no_document(spark, duck):
    known = "(select o_orderkey from orders)"
    conds = {"outgoing": f"l_orderkey in {known}", "incoming": f"l_partkey in {known}"}
    for direction, cond in conds.items():
        got = entry.queries()[f"edge_{direction}"](spark, str(DATA)).count()
        assert got == duck.execute(f"select count(*) from lineitem where {cond}").fetchone()[0]
    counts = entry.queries()["issuing_body_counts"](spark, str(DATA)).agg({"document_count": "sum"}).first()[0]
    assert counts == duck.execute("select count(*) from customer where c_nationkey in (select n_nationkey from nation)").fetchone()[0]
