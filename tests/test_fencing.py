"""Two sessions on one store, and the small rules of statements and commands."""

import pytest

from tessera.errors import SyntaxProblem, TransactionProblem
from tessera.repl import DEMO, answer, size
from tessera.session import Engine


@pytest.fixture
def root(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    engine.execute("CREATE TABLE t (a INT(8))")
    engine.execute("INSERT INTO t VALUES (1)")
    return f"file://{tmp_path}/db"


def values(engine):
    return sorted(r[0] for r in engine.execute("SELECT a FROM t").rows())


def test_commit_after_another_has_recovered_is_refused(spark, root):
    a = Engine(spark, root)
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (2)")
    b = Engine(spark, root, recover=True)
    b.execute("INSERT INTO t VALUES (3)")
    with pytest.raises(TransactionProblem, match="taken away"):
        a.execute("COMMIT")
    assert values(a) == values(b) == values(Engine(spark, root)) == [1, 3]
    a.execute("INSERT INTO t VALUES (4)")
    assert values(Engine(spark, root)) == [1, 3, 4]


def test_a_late_writer_does_not_unlock_another(spark, root):
    a = Engine(spark, root)
    a.execute("BEGIN")
    b = Engine(spark, root, recover=True)
    b.execute("BEGIN")
    a.execute("ROLLBACK")
    with pytest.raises(TransactionProblem, match="another writer"):
        Engine(spark, root).execute("BEGIN")
    b.execute("INSERT INTO t VALUES (5)")
    b.execute("COMMIT")
    assert values(Engine(spark, root)) == [1, 5]


def test_an_old_snapshot_is_refused(spark, root):
    a = Engine(spark, root)
    a.execute("BEGIN")
    a.staged.version -= 1
    a.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(TransactionProblem, match="version"):
        a.execute("COMMIT")
    assert values(Engine(spark, root)) == [1]


def test_shorthand_and_bracketed_query(spark, root):
    engine = Engine(spark, root)
    engine.execute("CREATE TABLE u a:int:8,b:string:4")
    assert [(c.name, c.kind, c.length) for c in engine.state.table("u").columns] == [("a", "INT", 8), ("b", "STRING", 4)]
    engine.execute("INSERT INTO u (SELECT a, 'x' FROM t)")
    assert [tuple(r) for r in engine.execute("SELECT * FROM u").rows()] == [(1, "x")]
    with pytest.raises(SyntaxProblem):
        engine.execute("CREATE TABLE v")


def test_many_literals_in_a_set(spark, root):
    engine = Engine(spark, root)
    many = ", ".join(map(str, range(1, 4000)))
    assert values(engine) == [r[0] for r in engine.execute(f"SELECT a FROM t WHERE a IN ({many})").rows()]
    assert engine.execute(f"SELECT a FROM t WHERE a NOT IN ({many})").rows() == []
    assert engine.execute("SELECT a FROM t WHERE a NOT IN (2, NULL)").rows() == []
    assert [r[0] for r in engine.execute("SELECT a FROM t WHERE a IN (NULL, 1, '1', 1.0)").rows()] == [1]
    assert engine.execute("SELECT a FROM t WHERE a IN (NULL)").rows() == []


def test_computed_doubles_are_stored(spark, root):
    engine = Engine(spark, root)
    engine.execute("CREATE TABLE d (x DOUBLE)")
    engine.execute("INSERT INTO d VALUES (0.1)")
    engine.execute("UPDATE d SET x = x * 3")
    assert engine.execute("SELECT x FROM d").rows()[0][0] == pytest.approx(0.3)


def test_vacuum_compacts(spark, root):
    engine = Engine(spark, root)
    for i in range(2, 6):
        engine.execute(f"INSERT INTO t VALUES ({i})")
    assert engine.vacuum("t")["t"]["compacted"] == 0
    assert engine.vacuum("t", most_segments=3)["t"]["compacted"] == 5
    assert values(engine) == values(Engine(spark, root)) == [1, 2, 3, 4, 5]
    assert len(Engine(spark, root).state.table("t").segments) == 1
    assert "t: " in engine.execute("VACUUM all").message
    engine.execute("INSERT INTO t VALUES (6)")


def test_update_of_all_rows_lists_no_files(spark, root, monkeypatch):
    engine = Engine(spark, root)
    engine.execute("INSERT INTO t VALUES (2)")
    monkeypatch.setattr(engine, "_touched", None)
    assert engine.execute("UPDATE t SET a = a + 10").changed == 2
    assert values(engine) == [11, 12]


def test_dump_numbers_rows(spark, root):
    engine = Engine(spark, root)
    engine.execute("INSERT INTO t VALUES (2), (3)")
    whole = engine.execute("DUMP t")
    assert whole.df.columns == ["row_number", "a", "file_name", "row_index"] and whole.message == "Total records: 3"
    rows = whole.rows()
    assert [r.row_number for r in rows] == [1, 2, 3] and sorted(r.a for r in rows) == [1, 2, 3]
    some = engine.execute("DUMP t 1 1")
    assert some.rows() == rows[1:2] and some.message.endswith("more rows are available.")
    assert engine.execute("DUMP t 5 2").message == "Total records: 3"
    engine.execute("CREATE TABLE none (a INT(8))")
    assert engine.execute("DUMP none").rows() == []


def test_plans_outlive_a_session(spark, root):
    engine = Engine(spark, root)
    engine.execute("SELECT a FROM t WHERE a = 1")
    engine.close()
    assert "WHERE a = 1" in Engine(spark, root).history(1)[0]


def test_explain_shows_every_stage(spark, root):
    text = answer(Engine(spark, root), "EXPLAIN SELECT a FROM t WHERE a = 1")
    for part in ("Syntax Tree", "TableRef", "Parsed Logical Plan", "Analyzed Logical Plan", "Optimized Logical Plan", "Physical Plan"):
        assert part in text


def test_sizes():
    assert [size(x) for x in ("4096", "64K", "32m", "1G")] == [4096, 65536, 32 << 20, 1 << 30]


def test_index_files_are_ranges(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db")
    for line in DEMO:
        engine.execute(line)
    engine.register("big", spark.range(0, 200_000).selectExpr("id", "cast(id % 1000 as string) name", "id % 90 age").repartition(6))
    engine.execute("INSERT INTO users SELECT id, name, age FROM big")
    newest = engine.state.table("users").segments[-1]
    spans = spark.read.parquet(f"{engine.store.files.root}/{newest.path}").selectExpr("_metadata.file_name f", "id").groupBy("f").agg({"id": "max"}).collect()
    low = spark.read.parquet(f"{engine.store.files.root}/{newest.path}").selectExpr("_metadata.file_name f", "id").groupBy("f").agg({"id": "min"}).collect()
    bounds = sorted((dict(map(tuple, low))[f], high) for f, high in map(tuple, spans))
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
