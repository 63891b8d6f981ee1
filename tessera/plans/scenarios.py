"""Queries that need an engine of their own: changes, transactions, indexes and commands over copies of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TransactionProblem
from ..operators.plan_api import PlanNode
from ..repl import DEMO
from ..session import Engine, render
from ..sources.scratch import scratch
from ..streaming import parquet_stream, run_once

NATION = "n_nationkey INT(8), n_name STRING(64), n_regionkey INT(8)"
_INTS = ("n_nationkey", "n_regionkey", "r_regionkey")


def copied(spark: SparkSession, sf_dir: str, source: str = "nation", columns: str = NATION) -> Engine:
    """An engine under the scratch folder with a copy `t` of a table."""
    engine = Engine(spark, scratch(spark))
    engine.register("source", spark.read.parquet(f"{sf_dir.rstrip('/')}/{source}.parquet"))
    engine.execute(f"CREATE TABLE t ({columns})")
    engine.execute("INSERT INTO t SELECT * FROM source")
    return engine


def typed(df: DataFrame) -> DataFrame:
    """Key columns as the tables of the oracle have them."""
    return df.select(*(F.col(c).cast("int").alias(c) if c in _INTS else F.col(f"`{c}`") for c in df.columns))


def whole(engine: Engine) -> DataFrame:
    return typed(engine.sql("SELECT * FROM t"))


def reopened(spark: SparkSession, engine: Engine) -> DataFrame:
    """What another session sees."""
    return whole(Engine(spark, engine.store.files.root))


def statements(*lines: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = copied(spark, sf_dir)
        for line in lines:
            engine.execute(line)
        return reopened(spark, engine)

    return run


def txn_own_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    for line in ("BEGIN", "DELETE FROM t WHERE n_regionkey = 1", "INSERT INTO t VALUES (77, 'NEW', 1)"):
        engine.execute(line)
    return whole(engine)


def txn_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("BEGIN")
    engine.execute("DELETE FROM t")
    return reopened(spark, engine)


def txn_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("BEGIN")
    engine.execute("DELETE FROM t")
    other = Engine(spark, engine.store.files.root, recover=True)  # as after a crash
    other.execute("INSERT INTO t VALUES (88, 'AFTER', 0)")
    try:
        engine.execute("COMMIT")
    except TransactionProblem:
        return reopened(spark, engine)
    raise AssertionError("a writer without its lock has committed")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir, "orders", "o_orderkey INT(16), o_custkey INT(16), o_orderstatus STRING(8), o_totalprice DOUBLE(32), o_orderdate STRING(32), o_orderpriority STRING(32)")
    engine.execute("CREATE INDEX orders_by_customer ON t(o_custkey)")
    found = engine.run_plan(PlanNode("INDEX_SCAN", {"table": "t", "index": "orders_by_customer", "key": "7"}))
    return found.select("o_orderkey", "o_custkey", "o_orderpriority")


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(copied(spark, sf_dir).execute("DUMP t 5 2").df.select("row_number", "n_nationkey", "n_name"))


def dump_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = copied(spark, sf_dir).execute("DUMP t 5 2").message.split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


def sys_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copied(spark, sf_dir).execute("TABLES").df.select("table_name", "column_name", "type", "length", "records")


def sys_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("CREATE INDEX by_region ON t(n_regionkey)")
    return engine.execute("INDEXES").df


def sys_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("CREATE INDEX by_region ON t(n_regionkey)")
    return engine.execute("CATALOG").df


def admin_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("DELETE FROM t WHERE n_nationkey < 5")
    return spark.createDataFrame([(x,) for x in engine.execute("LOGS 2").message.split("\n")], "line string")


def admin_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    for k in (1, 2, 3):
        engine.execute(f"SELECT n_name FROM t WHERE n_regionkey = {k}")
    engine.close()
    plans = Engine(spark, engine.store.files.root).history(2)  # they outlive the session
    return spark.createDataFrame([(p.split("\n")[0],) for p in plans], "statement string")


def admin_mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copied(spark, sf_dir).execute("MEM").df.select("setting")


def vacuum_compacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    for k in range(3):
        engine.execute(f"UPDATE t SET n_regionkey = n_regionkey + 10 WHERE n_regionkey = {k}")
    engine.vacuum(most_segments=0)
    return reopened(spark, engine)


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result printer's lines, numbered."""
    engine = Engine(spark, scratch(spark))
    engine.register("region", spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet"))
    lines = render(engine.sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def demo_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark))
    for line in DEMO:
        engine.execute(line)
    return engine.sql("SELECT users.name, orders.amount FROM users JOIN orders ON users.id = orders.user_id")


def shorthand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = copied(spark, sf_dir)
    engine.execute("CREATE TABLE u a:int:8,b:string:64")
    engine.execute("INSERT INTO u (SELECT n_nationkey, n_name FROM t WHERE n_regionkey = 3)")
    return engine.sql("SELECT a, b FROM u")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered stream, grouped like a table, run over all that is there."""
    engine = Engine(spark, scratch(spark))
    engine.register("events", parquet_stream(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", files_per_trigger=8))
    name = f"stream_counts_{abs(hash(engine.store.files.root))}"
    run_once(engine.sql("SELECT event_type, COUNT(*) AS cnt FROM events WHERE value >= 0 GROUP BY event_type"), name, "complete")
    return spark.table(name)


_T = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_LINES = " UNION ALL ".join(f"SELECT {n} AS n, '{x}' AS line" for n, x in ((0, "+-------------+-------------+"), (2, "+-------------+-------------+")))

SCENARIOS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "txn_commit": (
        statements("BEGIN", "INSERT INTO t VALUES (99, 'ATLANTIS', 2)", "UPDATE t SET n_regionkey = 4 WHERE n_nationkey = 99", "DELETE FROM t WHERE n_regionkey = 0", "COMMIT"),
        f"{_T} WHERE n_regionkey <> 0 UNION ALL SELECT 99, 'ATLANTIS', 4",
    ),
    "txn_rollback": (statements("BEGIN", "INSERT INTO t VALUES (99, 'ATLANTIS', 2)", "UPDATE t SET n_regionkey = 4", "DELETE FROM t WHERE n_nationkey < 9", "ROLLBACK"), _T),
    "txn_autocommit": (statements("INSERT INTO t VALUES (99, 'ATLANTIS', 2)", "DELETE FROM t WHERE n_regionkey = 2"), f"{_T} WHERE n_regionkey <> 2"),
    "txn_own_reads": (txn_own_reads, f"{_T} WHERE n_regionkey <> 1 UNION ALL SELECT 77, 'NEW', 1"),
    "txn_isolation": (txn_isolation, _T),
    "txn_recover": (txn_recover, f"{_T} UNION ALL SELECT 88, 'AFTER', 0"),
    "dml_update_all": (statements("UPDATE t SET n_regionkey = n_regionkey * 2 + 1"), "SELECT n_nationkey, n_name, n_regionkey * 2 + 1 AS n_regionkey FROM nation"),
    "dml_delete_all": (statements("DELETE FROM t"), f"{_T} WHERE n_nationkey < 0"),
    "dml_insert_select": (statements("INSERT INTO t SELECT n_nationkey + 100, n_name, n_regionkey FROM source WHERE n_regionkey = 4"), f"{_T} UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 4"),
    "index_lookup_after_create": (index_lookup, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey = 7"),
    "dump_rows": (dump_rows, "SELECT CAST(n_nationkey + 1 AS BIGINT) AS row_number, n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 2 AND 6"),
    "dump_totals": (dump_totals, "SELECT 'Total records: ' || COUNT(*) AS line FROM nation UNION ALL SELECT 'Result truncated; more rows are available.'"),
    "sys_tables": (
        sys_tables,
        "SELECT 't' AS table_name, c.name AS column_name, c.type, CAST(c.length AS BIGINT) AS length, (SELECT COUNT(*) FROM nation) AS records FROM (VALUES ('n_nationkey', 'INT', 8), ('n_name', 'STRING', 64), ('n_regionkey', 'INT', 8)) c(name, type, length)",
    ),
    "sys_indexes": (sys_indexes, "SELECT 'by_region' AS index_name, 't' AS table_name, 'n_regionkey' AS column_name, FALSE AS is_unique"),
    "sys_catalog": (
        sys_catalog,
        "SELECT 'SYS_TABLES' AS catalog, 't' AS name, 'n_nationkey:INT:8, n_name:STRING:64, n_regionkey:INT:8 records=' || (SELECT COUNT(*) FROM nation) AS description UNION ALL SELECT 'SYS_INDEXES', 'by_region', 't(n_regionkey) unique=False'",
    ),
    "admin_logs": (
        admin_logs,
        "SELECT '#2 INSERT INTO t SELECT * FROM source (' || COUNT(*) || ' rows)' AS line FROM nation UNION ALL SELECT '#3 DELETE FROM t WHERE n_nationkey < 5 (' || COUNT(*) || ' rows)' FROM nation WHERE n_nationkey < 5",
    ),
    "admin_plans": (admin_plans, "SELECT 'SELECT n_name FROM t WHERE n_regionkey = ' || k AS statement FROM (VALUES (2), (3)) x(k)"),
    "admin_mem": (admin_mem, "SELECT 'spark.' || s AS setting FROM (VALUES ('executor.memory'), ('driver.memory'), ('memory.fraction'), ('memory.storageFraction')) x(s)"),
    "vacuum_compacts": (vacuum_compacts, "SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 3 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "result_printer": (
        printed,
        f"{_LINES} UNION ALL SELECT 1, '| r_regionkey | r_name      |' UNION ALL SELECT CAST(3 + r_regionkey AS INT), '| ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' FROM region "
        "UNION ALL SELECT CAST(3 + COUNT(*) AS INT), '+-------------+-------------+' FROM region UNION ALL SELECT CAST(4 + COUNT(*) AS INT), '(' || COUNT(*) || ' rows)' FROM region",
    ),
    "demo_seed": (demo_seed, "SELECT * FROM (VALUES ('Alice', CAST(200 AS BIGINT)), ('Bob', 300), ('Carol', 150), ('Dave', 500)) x(name, amount)"),
    "shorthand_table": (shorthand_table, "SELECT CAST(n_nationkey AS BIGINT) AS a, n_name AS b FROM nation WHERE n_regionkey = 3"),
    "stream_counts": (stream_counts, "SELECT event_type, COUNT(*) AS cnt FROM events WHERE value >= 0 GROUP BY event_type"),
}
