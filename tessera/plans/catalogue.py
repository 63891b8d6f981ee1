"""The queries by which the engine is measured and checked: each in the dialect, beside SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plan_api import PlanExecutor, PlanNode
from .compiler import Compiler
from .parser import parse
from .scenarios import NATION, SCENARIOS, copied, whole

Query = Callable[[SparkSession, str], DataFrame]


def resolver(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name.lower()}.parquet")


@dataclass(frozen=True)
class Entry:
    sql: str  # in the dialect
    oracle: str | None = None  # if it differs
    decimals: dict[str, int] | None = None  # columns whose last digits depend on the order of summation


def _rounded(df: DataFrame, decimals: dict[str, int] | None) -> DataFrame:
    return df.select(*(F.round(c, decimals[c]).alias(c) if decimals and c in decimals else F.col(c) for c in df.columns)) if decimals else df


_SQL: dict[str, Entry] = {
    "scan_all": Entry("SELECT * FROM region"),
    "scan_lineitem": Entry("SELECT * FROM lineitem"),
    "project_cols": Entry("SELECT n_name, n_regionkey FROM nation"),
    "project_computed": Entry(
        "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS more, 0 - l_linenumber AS less, -l_linenumber AS minus FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS more, CAST(0 - l_linenumber AS BIGINT) AS less, -l_linenumber AS minus FROM lineitem",
    ),
    "filter_eq_string": Entry("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": Entry("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_range": Entry("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12"),
    "filter_and_or": Entry("SELECT p_partkey, p_size FROM part WHERE (p_type = 'ECONOMY' AND p_size > 10) OR (p_size <= 3 AND p_retailprice > 1000)"),
    "filter_not": Entry("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal > 5000)"),
    "filter_col_vs_col": Entry("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber"),
    "filter_arith_int": Entry("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey / 10 > 100", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey // 10 > 100"),
    "filter_arith_double": Entry("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1.0 - l_discount) > 90000"),
    "filter_in": Entry("SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')"),
    "filter_like": Entry("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment NOT LIKE 'A%'"),
    "filter_between": Entry("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000"),
    "point_lookup": Entry("SELECT * FROM orders WHERE o_orderkey = 7"),
    "distinct_one": Entry("SELECT DISTINCT c_mktsegment FROM customer"),
    "distinct_multi": Entry("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "order_by_multi": Entry("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey ASC"),
    "order_by_below_projection": Entry("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25"),
    "top_n": Entry("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": Entry("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    "limit_comma": Entry("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 40", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    "limit_zero": Entry("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0"),
    "offset_only": Entry("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "join_inner_equi": Entry("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "join_reversed_on": Entry("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"),
    "join_inner_large": Entry("SELECT o.o_orderkey, l.l_linenumber, o.o_orderpriority FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 200000"),
    "join_conjunction": Entry("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal"),
    "join_inner_theta": Entry("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey < r.r_regionkey"),
    "join_left": Entry("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_left_padded": Entry(
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey"
    ),
    "join_right": Entry("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_right_padded": Entry(
        "SELECT o.o_orderkey, c.c_custkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey"
    ),
    "join_left_theta": Entry("SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey"),
    "join_full": Entry(
        "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey"
    ),
    "join_semi": Entry("SELECT s.s_suppkey FROM supplier s LEFT SEMI JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2)"),
    "join_anti": Entry("SELECT s.s_suppkey FROM supplier s LEFT ANTI JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2)"),
    "join_cross_comma": Entry("SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r"),
    "join_comma_where": Entry("SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey"),
    "join_three_way": Entry("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'"),
    "join_self": Entry("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "is_null_after_join": Entry("SELECT r.r_regionkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey WHERE n.n_nationkey IS NULL"),
    "agg_global": Entry(
        "SELECT COUNT(*) AS cnt, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem",
        "SELECT COUNT(*) AS cnt, ROUND(SUM(l_quantity), 4) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem",
        {"s": 4, "a": 4},
    ),
    "agg_variance_stddev": Entry(
        "SELECT VARIANCE(l_quantity) AS v, STDDEV(l_quantity) AS sd FROM lineitem", "SELECT ROUND(VAR_POP(l_quantity), 4) AS v, ROUND(STDDEV_POP(l_quantity), 4) AS sd FROM lineitem", {"v": 4, "sd": 4}
    ),
    "agg_empty_input": Entry("SELECT COUNT(*) AS cnt, MIN(o_orderkey) AS mn, MAX(o_orderkey) AS mx FROM orders WHERE o_orderkey < 0"),
    "agg_min_max_string": Entry("SELECT MIN(c_name) AS mn, MAX(c_name) AS mx FROM customer"),
    "agg_sum_int": Entry("SELECT SUM(l_linenumber) AS s, COUNT(l_linenumber) AS n FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(l_linenumber) AS n FROM lineitem"),
    "agg_count_distinct": Entry("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "count_of_nulls": Entry("SELECT COUNT(*) AS rows_all, COUNT(n.n_nationkey) AS rows_known FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey"),
    "group_by_one": Entry("SELECT o_orderpriority, COUNT(*) AS cnt FROM orders GROUP BY o_orderpriority"),
    "group_by_multi": Entry(
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, SUM(l_quantity) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, ROUND(SUM(l_quantity), 4) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus",
        {"qty": 4},
    ),
    "group_by_expr_arg": Entry(
        "SELECT l_returnflag, SUM(l_extendedprice * (1.0 - l_discount)) AS revenue FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1.0 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag",
        {"revenue": 2},
    ),
    "group_select_order": Entry("SELECT COUNT(*) AS cnt, l_linestatus FROM lineitem GROUP BY l_linestatus, l_returnflag"),
    "group_implicit": Entry("SELECT c_mktsegment, COUNT(*) AS cnt FROM customer", "SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment"),
    "group_expression_over": Entry(
        "SELECT o_orderpriority, COUNT(*) * 2 + 1 AS twice FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(COUNT(*) * 2 + 1 AS BIGINT) AS twice FROM orders GROUP BY o_orderpriority"
    ),
    "having_alias": Entry("SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING cnt > 15"),
    "having_call": Entry("SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND MIN(o_totalprice) < 20000"),
    "group_distinct_having": Entry("SELECT c_nationkey FROM customer HAVING c_nationkey > 10", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING c_nationkey > 10"),
    "group_order_limit": Entry("SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY cnt DESC, o_custkey LIMIT 5"),
    "join_group_agg": Entry("SELECT n.n_name, COUNT(*) AS cnt FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0 GROUP BY n.n_name"),
    "subquery_from": Entry("SELECT sub.c_name FROM (SELECT c_name, c_acctbal FROM customer WHERE c_acctbal >= 9000) AS sub ORDER BY sub.c_name"),
    "subquery_agg_join": Entry("SELECT n.n_name, t.cnt FROM (SELECT c_nationkey, COUNT(*) AS cnt FROM customer GROUP BY c_nationkey) t JOIN nation n ON t.c_nationkey = n.n_nationkey"),
    "subquery_nested": Entry("SELECT x.o_custkey FROM (SELECT y.o_custkey FROM (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) y WHERE y.o_totalprice < 101000) x"),
    "subquery_limited": Entry("SELECT COUNT(*) AS cnt FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) t WHERE t.o_orderkey > 10"),
    "set_union": Entry("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "set_union_all": Entry("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "set_intersect": Entry("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "set_except": Entry("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "sort_nulls": Entry(
        "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey ORDER BY n.n_nationkey, r.r_regionkey LIMIT 3",
        "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey ORDER BY n.n_nationkey NULLS FIRST, r.r_regionkey LIMIT 3",
    ),
    "sort_nulls_descending": Entry(
        "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey ORDER BY n.n_nationkey DESC, r.r_regionkey LIMIT 4",
        "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey ORDER BY n.n_nationkey DESC NULLS LAST, r.r_regionkey LIMIT 4",
    ),
    "agg_samples": Entry(
        "SELECT l_returnflag, VAR_SAMP(l_quantity) AS vs, STDDEV_SAMP(l_quantity) AS ss, VAR_POP(l_quantity) AS vp, STDDEV_POP(l_quantity) AS sp, VAR(l_quantity) AS v FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(VAR_SAMP(l_quantity), 4) AS vs, ROUND(STDDEV_SAMP(l_quantity), 4) AS ss, ROUND(VAR_POP(l_quantity), 4) AS vp, ROUND(STDDEV_POP(l_quantity), 4) AS sp, ROUND(VAR_POP(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag",
        {"vs": 4, "ss": 4, "vp": 4, "sp": 4, "v": 4},
    ),
    "default_names": Entry(
        "SELECT COUNT(*), MAX(l_quantity), MIN(l_linenumber + 1) FROM lineitem",
        'SELECT COUNT(*) AS "COUNT(*)", MAX(l_quantity) AS "MAX(l_quantity)", CAST(MIN(l_linenumber + 1) AS BIGINT) AS "MIN((l_linenumber + 1))" FROM lineitem',
    ),
    "default_names_computed": Entry("SELECT n_nationkey * 2, -n_regionkey FROM nation", 'SELECT CAST(n_nationkey * 2 AS BIGINT) AS "(n_nationkey * 2)", -n_regionkey AS "(-n_regionkey)" FROM nation'),
    "comments": Entry("SELECT r_name -- the name\nFROM region -- all of them", "SELECT r_name FROM region"),
    "names_any_case": Entry("select N.N_Name from NATION n where n.N_NATIONKEY >= 3", "SELECT n_name FROM nation WHERE n_nationkey >= 3"),
    "filter_in_many": Entry(f"SELECT o_orderkey FROM orders WHERE o_orderkey IN ({', '.join(map(str, range(0, 9000, 3)))})"),
    "filter_in_null": Entry("SELECT r.r_regionkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey WHERE n.n_nationkey NOT IN (1, 2) OR n.n_nationkey IN (NULL, 1)"),
    "events_by_type": Entry(
        "SELECT event_type, COUNT(*) AS cnt, AVG(value) AS a FROM events WHERE value >= 0 GROUP BY event_type", "SELECT event_type, COUNT(*) AS cnt, ROUND(AVG(value), 4) AS a FROM events WHERE value >= 0 GROUP BY event_type", {"a": 4}
    ),
}


def _sql_query(entry: Entry) -> Query:
    return lambda spark, sf_dir: _rounded(Compiler(resolver(spark, sf_dir)).query(parse(entry.sql)).output(), entry.decimals)


def _plan_query(plan: PlanNode) -> Query:
    return lambda spark, sf_dir: PlanExecutor(resolver(spark, sf_dir), lambda table, index: index).execute(plan)


def _table(name: str) -> PlanNode:
    return PlanNode("TABLE_SCAN", {"table": name})


_PLANS: dict[str, tuple[PlanNode, str]] = {
    "plan_index_scan": (
        PlanNode("PROJECTION", {}, (PlanNode("INDEX_SCAN", {"table": "orders", "index": "o_orderkey", "key": "7"}),), ("o_orderkey", "o_custkey")),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7",
    ),
    "plan_hash_join": (
        PlanNode("PROJECTION", {}, (PlanNode("HASH_JOIN", {"left_key": "n_regionkey", "right_key": "r_regionkey", "join_type": "INNER"}, (_table("nation"), _table("region"))),), ("n_name", "r_name")),
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "plan_merge_join": (
        PlanNode("PROJECTION", {}, (PlanNode("MERGE_JOIN", {"left_key": "o_custkey", "right_key": "c_custkey"}, (_table("orders"), _table("customer"))),), ("o_orderkey", "c_name")),
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "plan_nested_loop_join": (
        PlanNode("PROJECTION", {}, (PlanNode("NESTED_LOOP_JOIN", {"condition": "r_regionkey > n_nationkey", "join_type": "left"}, (_table("region"), _table("nation"))),), ("r_regionkey", "n_nationkey")),
        "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON r_regionkey > n_nationkey",
    ),
    "plan_sort_limit": (
        PlanNode("LIMIT", {"limit": "10", "offset": "3"}, (PlanNode("SORT", {"order_by": "o_totalprice:DESC, o_orderkey"}, (PlanNode("PROJECTION", {}, (_table("orders"),), ("o_orderkey", "o_totalprice")),)),)),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 3",
    ),
    "plan_aggregate_having": (
        PlanNode("AGGREGATE", {"group_by": "o_custkey", "aggregates": "COUNT:*:cnt; MAX(o_totalprice) AS top", "having": "cnt > 15"}, (PlanNode("FILTER", {"condition": "o_orderstatus <> 'P'"}, (_table("orders"),)),)),
        "SELECT o_custkey, COUNT(*) AS cnt, MAX(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) > 15",
    ),
    "plan_aggs_all_forms": (
        PlanNode(
            "AGGREGATE",
            {"group_by": "o_orderstatus", "agg.1": "COUNT(*) AS n", "agg.2": "MAX(o_totalprice)=top", "agg.3": "MIN:o_totalprice:least", "agg.4": "MAX o_custkey", "agg.5": "COUNT", "agg.6": "COUNT(o_custkey) buyers"},
            (_table("orders"),),
        ),
        'SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS top, MIN(o_totalprice) AS least, MAX(o_custkey) AS "MAX(o_custkey)", COUNT(*) AS "COUNT(*)", COUNT(o_custkey) AS buyers FROM orders GROUP BY o_orderstatus',
    ),
    "plan_set_operations": (
        PlanNode(
            "DIFFERENCE",
            {},
            (
                PlanNode("UNION", {}, tuple(PlanNode("PROJECTION", {}, (_table(t),), (c,)) for t, c in (("nation", "n_nationkey"), ("customer", "c_nationkey")))),
                PlanNode("INTERSECT", {}, tuple(PlanNode("PROJECTION", {}, (_table(t),), (c,)) for t, c in (("region", "r_regionkey"), ("supplier", "s_nationkey")))),
            ),
        ),
        "(SELECT n_nationkey FROM nation UNION SELECT c_nationkey FROM customer) EXCEPT (SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier)",
    ),
    "plan_distinct_alias": (
        PlanNode("PROJECTION", {}, (PlanNode("ALIAS", {"alias": "c"}, (PlanNode("DISTINCT", {}, (PlanNode("PROJECTION", {}, (_table("customer"),), ("c_mktsegment", "c_nationkey")),)),)),), ("c.c_nationkey", "c.c_mktsegment")),
        "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    ),
}


def _changed(columns: str, source: str, statement: str) -> Query:
    """A statement that changes a copy of a table, made under the shared scratch folder; then the table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = copied(spark, sf_dir, source, columns)
        engine.execute(statement)
        return whole(engine)

    return run


_CHANGES: dict[str, tuple[Query, str]] = {
    "dml_insert": (_changed("r_regionkey INT(8), r_name STRING(64)", "region", "INSERT INTO t VALUES (99, 'ATLANTIS')"), "SELECT * FROM region UNION ALL SELECT CAST(99 AS INT) AS r_regionkey, 'ATLANTIS' AS r_name"),
    "dml_update": (
        _changed(NATION, "nation", "UPDATE t SET n_regionkey = n_regionkey + 1 WHERE n_regionkey = 2"),
        "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation",
    ),
    "dml_delete": (_changed(NATION, "nation", "DELETE FROM t WHERE n_regionkey = 2"), "SELECT * FROM nation WHERE NOT (n_regionkey = 2)"),
    **SCENARIOS,
}


def queries() -> dict[str, Query]:
    return {k: _sql_query(e) for k, e in _SQL.items()} | {k: _plan_query(p) for k, (p, _) in _PLANS.items()} | {k: q for k, (q, _) in _CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.oracle or e.sql for k, e in _SQL.items()} | {k: s for k, (_, s) in _PLANS.items()} | {k: s for k, (_, s) in _CHANGES.items()}
