"""Every query of the catalogue against DuckDB on the smallest tables, and random expressions."""

import glob
import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.plans import catalogue
from tessera.plans.compiler import Compiler
from tessera.plans.parser import parse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df, expected = catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name])
    assert df.columns == expected.columns
    assert plain(df.collect()) == plain(expected.fetchall())


numbers = st.one_of(st.integers(0, 50).map(str), st.sampled_from(["p_size", "p_partkey", "p_retailprice", "2.5"]))
sums = st.recursive(numbers, lambda s: st.tuples(s, st.sampled_from(["+", "-", "*"]), s).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=4)
tests = st.tuples(sums, st.sampled_from(["<", "<=", ">", ">=", "=", "<>"]), sums).map(" ".join)
conditions = st.recursive(tests, lambda c: st.one_of(st.tuples(c, st.sampled_from(["AND", "OR"]), c).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), c.map(lambda x: f"NOT ({x})")), max_leaves=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(conditions)
def test_random_conditions(spark, duck, condition):
    text = f"SELECT p_partkey FROM part WHERE {condition}"
    found = Compiler(catalogue.resolver(spark, SF)).query(parse(text)).output().collect()
    assert plain(found) == plain(duck.sql(text).fetchall())


def plan_of(spark, text):
    return Compiler(catalogue.resolver(spark, SF)).query(parse(text)).output()._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000")
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderdate" not in plan


def test_top_k_and_partial_aggregates(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3")
    assert "partial_count" in plan_of(spark, "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
