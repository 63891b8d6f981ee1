"""The engine on small tables: queries, changes, transactions, admin commands."""

import pytest

from tessera.errors import EngineError, NameProblem, SyntaxProblem, TransactionProblem, TypeProblem
from tessera.operators.plan_api import PlanNode
from tessera.repl import DEMO, answer
from tessera.session import Engine, render


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    for line in DEMO:
        e.execute(line)
    return e


def rows(engine, text):
    return [tuple(r) for r in engine.execute(text).rows()]


def make(engine, name, columns, values):
    engine.execute(f"CREATE TABLE {name} ({columns})")
    engine.execute(f"INSERT INTO {name} VALUES {values}")


def test_predicates(engine):
    make(engine, "items", "id INT(16), category STRING(16), price INT(8), qty INT(8)", "(1,'A',15,2),(2,'B',5,5),(3,'A',8,3),(4,'B',20,1)")
    assert rows(engine, "SELECT id FROM items WHERE (category = 'A' AND price > 10) OR (category = 'B' AND qty = 5) ORDER BY id") == [(1,), (2,)]
    assert rows(engine, "SELECT id, price / qty AS d, price % qty AS m, 0 - price / 7 AS n FROM items WHERE id <= 2 ORDER BY id") == [(1, 7, 1, -2), (2, 1, 0, 0)]
    assert rows(engine, "SELECT SUM(price * qty) FROM items") == [(99,)]
    assert engine.sql("SELECT SUM(price * qty), COUNT(*) FROM items").columns == ["SUM((price * qty))", "COUNT(*)"]


def test_distinct_order_limit(engine):
    make(engine, "numbers", "value INT(8)", "(1),(2),(2),(3),(3),(4)")
    assert rows(engine, "SELECT DISTINCT value FROM numbers ORDER BY value DESC") == [(4,), (3,), (2,), (1,)]
    assert rows(engine, "SELECT DISTINCT value FROM numbers ORDER BY value LIMIT 2 OFFSET 1") == [(2,), (3,)]
    assert rows(engine, "SELECT DISTINCT value FROM numbers ORDER BY value LIMIT 2, 1") == [(2,), (3,)]
    assert rows(engine, "SELECT value FROM numbers LIMIT 0") == []


def test_outer_joins_pad(engine):
    make(engine, "people", "id INT(16), name STRING(32)", "(1,'Alice'),(2,'Bob'),(3,'Carol')")
    make(engine, "purchases", "user_id INT(16), amount INT(16)", "(1,100),(2,200),(4,400)")
    assert rows(engine, "SELECT people.id, purchases.amount FROM people LEFT JOIN purchases ON people.id = purchases.user_id ORDER BY people.id") == [(1, 100), (2, 200), (3, None)]
    assert rows(engine, "SELECT purchases.user_id, people.name FROM people RIGHT JOIN purchases ON purchases.user_id = people.id ORDER BY purchases.user_id") == [(1, "Alice"), (2, "Bob"), (4, None)]
    assert rows(engine, "SELECT p.id FROM people p LEFT JOIN purchases q ON p.id = q.user_id WHERE q.amount IS NULL") == [(3,)]
    assert rows(engine, "SELECT COUNT(*), COUNT(q.amount), SUM(q.amount), MIN(q.amount) FROM people p LEFT JOIN purchases q ON p.id = q.user_id") == [(3, 2, 300, 100)]


def test_subquery_and_self_join(engine):
    assert rows(engine, "SELECT sub.name FROM (SELECT name, age FROM users WHERE age >= 40) AS sub ORDER BY sub.name") == [("Bob",), ("Dave",)]
    assert rows(engine, "SELECT a.name, b.name FROM users a JOIN users b ON a.age < b.age WHERE b.name = 'Alice'") == [("Carol", "Alice")]


def test_population_variance(engine):
    make(engine, "metrics", "val INT(8)", "(10),(20),(30)")
    ((v, s),) = rows(engine, "SELECT VARIANCE(val), STDDEV(val) FROM metrics")
    assert v == pytest.approx(66.666667) and s == pytest.approx(8.164966)
    assert rows(engine, "SELECT SUM(val), AVG(val), COUNT(*) FROM metrics WHERE val > 99") == [(None, None, 0)]


def test_having(engine):
    make(engine, "sales", "region STRING(16), amount INT(8)", "('north',10),('north',15),('south',20),('south',5),('south',8)")
    for text in ("HAVING cnt > 2", "HAVING COUNT(*) > 2"):
        assert rows(engine, f"SELECT region, COUNT(*) AS cnt, SUM(amount) AS total FROM sales GROUP BY region {text}") == [("south", 3, 33)]
    assert rows(engine, "SELECT SUM(amount), region FROM sales HAVING region <> 'north'") == [(33, "south")]
    with pytest.raises(NameProblem):
        engine.execute("SELECT amount, COUNT(*) FROM sales GROUP BY region")


def test_update(engine):
    assert engine.execute("UPDATE users SET name = 'Alicia', age = age + 1 WHERE id = 1").changed == 1
    assert rows(engine, "SELECT name, age FROM users ORDER BY id") == [("Alicia", 31), ("Bob", 42), ("Carol", 28), ("Dave", 55)]
    assert engine.execute("UPDATE users SET age = id, id = age WHERE id = 2").changed == 1  # both from the old row
    assert rows(engine, "SELECT id, age FROM users WHERE name = 'Bob'") == [(42, 2)]
    with pytest.raises(Exception, match="whole numbers"):
        engine.execute("UPDATE users SET age = age * 1.3 WHERE id = 1")
    assert engine.execute("UPDATE users SET age = 0 WHERE id = 12345").changed == 0


def test_delete(engine):
    assert engine.execute("DELETE FROM users WHERE id = 2").changed == 1
    assert rows(engine, "SELECT id FROM users ORDER BY id") == [(1,), (3,), (4,)]
    assert engine.execute("DELETE FROM users").changed == 3
    assert rows(engine, "SELECT * FROM users") == []
    assert rows(engine, "SELECT COUNT(*) FROM users") == [(0,)]


def test_only_touched_files_are_rewritten(engine):
    engine.execute("INSERT INTO users VALUES (5, 'Eve', 20)")
    before = [s.path for s in engine.state.table("users").segments]
    engine.execute("UPDATE users SET age = 21 WHERE id = 5")
    after = [s.path for s in engine.state.table("users").segments]
    assert before[0] in after and before[1] not in after


def test_insert_select_and_quoted_commas(engine):
    engine.execute("INSERT INTO users VALUES (9, 'a, b', 1)")
    engine.execute("INSERT INTO users SELECT id + 100, name, age FROM users WHERE id = 9")
    assert rows(engine, "SELECT id, name FROM users WHERE id > 8 ORDER BY id") == [(9, "a, b"), (109, "a, b")]


def test_length_and_type_are_checked(engine):
    engine.execute("CREATE TABLE small (id INT(4), v STRING(10))")
    for bad in ("(1, 'xxxxxxxxxxx')", "(12345, 'x')", "('abc', 'x')", "(1)", "(1.5, 'x')"):
        with pytest.raises(TypeProblem):
            engine.execute(f"INSERT INTO small VALUES {bad}")
    engine.execute("INSERT INTO small VALUES (1, NULL)")
    with pytest.raises(Exception, match="longer than"):
        engine.execute("INSERT INTO small SELECT id, 'xxxxxxxxxxx' FROM users")
    assert rows(engine, "SELECT * FROM small") == [(1, None)]


def test_rollback_and_commit(engine, spark):
    engine.execute("BEGIN")
    with pytest.raises(TransactionProblem):
        engine.execute("BEGIN")
    engine.execute("INSERT INTO users VALUES (7, 'Gus', 7)")
    engine.execute("DELETE FROM users WHERE id = 1")
    engine.execute("UPDATE users SET age = 1 WHERE id = 2")
    assert rows(engine, "SELECT id, age FROM users ORDER BY id LIMIT 1") == [(2, 1)]  # its own changes
    other = Engine(spark, engine.store.files.root)
    assert len(rows(other, "SELECT * FROM users")) == 4  # others don't see them
    with pytest.raises(TransactionProblem):
        other.execute("DELETE FROM users")
    engine.execute("ROLLBACK")
    assert rows(engine, "SELECT id, age FROM users ORDER BY id") == [(1, 30), (2, 42), (3, 28), (4, 55)]
    engine.execute("BEGIN")
    engine.execute("INSERT INTO users VALUES (8, 'Hal', 8)")
    engine.execute("COMMIT")
    with pytest.raises(TransactionProblem):
        engine.execute("COMMIT")
    assert len(rows(Engine(spark, engine.store.files.root), "SELECT * FROM users")) == 5


def test_recovery_after_a_lost_writer(engine, spark):
    engine.execute("BEGIN")
    engine.execute("INSERT INTO users VALUES (7, 'Gus', 7)")
    with pytest.raises(TransactionProblem):
        Engine(spark, engine.store.files.root).execute("DELETE FROM users")
    other = Engine(spark, engine.store.files.root, recover=True)  # the first writer is gone for good
    assert len(rows(other, "SELECT * FROM users")) == 4
    assert other.vacuum("users")["users"]["cleared"] >= 1
    assert other.execute("DELETE FROM users WHERE id = 1").changed == 1
    engine.staged = None


def test_dump_of_a_registered_table(engine, spark):
    engine.register("numbers", spark.range(5))
    assert engine.dump("numbers", 2, 1).count() == 2


def test_persistence_and_journal(engine, spark):
    other = Engine(spark, engine.store.files.root)
    assert rows(other, "SELECT name FROM users WHERE id = 2") == [("Bob",)]
    assert [tuple(r) for r in other.indexes().collect()] == [("idx_users_id", "users", "id", False)]
    assert "CREATE INDEX" in other.log(1)[0]
    assert len(other.describe_index("idx_users_id")) >= 1


def test_vacuum(engine):
    engine.execute("UPDATE users SET age = 1 WHERE id = 1")
    found = engine.vacuum("users")["users"]
    assert found["cleared"] >= 1 and found["reclaimed_bytes"] > 0
    assert len(rows(engine, "SELECT * FROM users")) == 4
    assert engine.vacuum()["users"]["cleared"] == 0


def test_plan_history_is_bounded(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", plan_history=2)
    make(e, "t", "v INT(8)", "(1),(2)")
    for n in range(3):
        e.sql(f"SELECT v FROM t WHERE v = {n}")
    assert len(e.history()) == 2 and "v = 1" in e.history()[0] and len(e.history(1)) == 1


def test_quota(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db", max_bytes=100)
    e.execute("CREATE TABLE bulky (payload STRING(64))")
    with pytest.raises(EngineError, match="quota"):
        e.execute(f"INSERT INTO bulky VALUES ('{'x' * 40}')")
    assert rows(e, "SELECT * FROM bulky") == []


def test_corrupt_file_is_noticed(engine):
    from pathlib import Path

    for f in Path(engine.store.files.root.removeprefix("file://")).glob("tables/users/*/*.parquet"):
        f.write_bytes(b"nothing" + f.read_bytes()[7:-4] + b"zzzz")
    with pytest.raises(Exception):
        rows(engine, "SELECT * FROM users WHERE age > 1")


def test_errors(engine):
    for text, kind in (
        ("SELECT nothing FROM users", NameProblem),
        ("SELECT id FROM nowhere", NameProblem),
        ("SELECT id FROM users JOIN orders ON users.id = orders.user_id", NameProblem),
        ("SELECT id FROM users WHERE age", TypeProblem),
        ("SELECT id FROM users WHERE name > age", TypeProblem),
        ("SELECT id FROM users WHERE age = 'old'", TypeProblem),
        ("SELECT name + 1 FROM users", TypeProblem),
        ("SELECT SUM(name) FROM users", TypeProblem),
        ("SELECT upper(name) FROM users", SyntaxProblem),
        ("SELECT id FROM users WHERE COUNT(*) > 1", SyntaxProblem),
        ("CREATE TABLE users (id INT)", NameProblem),
        ("CREATE TABLE t (id INT, ID INT)", TypeProblem),
        ("CREATE INDEX i ON users(nothing)", NameProblem),
    ):
        with pytest.raises(kind):
            engine.execute(text)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(engine, "SELECT id / 0 FROM users")


def test_plan_api(engine):
    look = PlanNode("INDEX_SCAN", {"table": "users", "index": "idx_users_id", "key": "2"})
    assert [r["name"] for r in engine.run_plan(look).collect()] == ["Bob"]
    join = PlanNode("HASH_JOIN", {"left_key": "id", "right_key": "user_id", "condition": "users.id = orders.user_id"}, (PlanNode("TABLE_SCAN", {"table": "users"}), PlanNode("TABLE_SCAN", {"table": "orders"})))
    found = engine.run_plan(PlanNode("PROJECTION", {}, (join,), ("name", "amount")))
    assert sorted(map(tuple, found.collect())) == [("Alice", 200), ("Bob", 300), ("Carol", 150), ("Dave", 500)]
    down = PlanNode("SORT", {"keys": "age:DESC"}, (PlanNode("TABLE_SCAN", {"table": "users"}),))
    assert [r["age"] for r in engine.run_plan(down).collect()] == [55, 42, 30, 28]
    group = PlanNode("AGGREGATE", {"aggs": "COUNT", "agg.1": "SUM(age)=total", "agg.2": "AVG age", "agg.3": "STDDEV_SAMP:age:s"}, (PlanNode("TABLE_SCAN", {"table": "users"}),))
    assert engine.run_plan(group).columns == ["COUNT(*)", "total", "AVG(age)", "s"]
    with pytest.raises(SyntaxProblem):
        engine.run_plan(PlanNode("NOTHING"))


def test_shell(engine):
    text = answer(engine, "SELECT name, age FROM users ORDER BY id LIMIT 1")
    assert "| Alice" in text and "(1 rows)" in text
    assert answer(engine, "SELECT x FROM users").startswith("error: no column x")
    for line in ("TABLES", "INDEXES", "CATALOG", "DUMP users", "DUMP users 2 1", "PLANS", "LOGS 2", "MEM", "HELP", "EXPLAIN SELECT * FROM users", "VACUUM"):
        assert "error" not in answer(engine, line).lower()[:6]
    assert "(2 rows)" in answer(engine, "DUMP users 2 1")
    assert "NULL" in render(engine.sql("SELECT NULL AS n FROM users"))


def test_stream(spark, engine, tmp_path):
    from tessera.streaming import parquet_stream, run_once

    spark.range(10).write.parquet(f"{tmp_path}/s")
    engine.register("ticks", parquet_stream(spark, f"{tmp_path}/s"))
    run_once(engine.sql("SELECT id, id * 2 AS twice FROM ticks WHERE id > 6"), "out_ticks")
    assert sorted(map(tuple, spark.table("out_ticks").collect())) == [(7, 14), (8, 16), (9, 18)]
