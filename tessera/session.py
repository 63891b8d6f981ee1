"""The engine: statements and commands over a catalog of versioned tables."""

from __future__ import annotations

import copy
import re
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .errors import EngineError, NameProblem, SyntaxProblem, TransactionProblem, TypeProblem
from .operators import relation as R
from .operators.plan_api import PlanExecutor, PlanNode
from .plans import nodes as N
from .plans.compiler import Compiler, Expressions
from .plans.parser import parse
from .sources.catalog import JOURNAL, Index, Segment, State, Store, Table
from .types import ColumnDef, kind_of

HELP = """SELECT ... | INSERT INTO t VALUES (...) | UPDATE t SET c = e [WHERE p] | DELETE FROM t [WHERE p]
CREATE TABLE t (c TYPE(n), ...) | CREATE TABLE t c:type:n,... | CREATE INDEX i ON t(c)
BEGIN | COMMIT | ROLLBACK
TABLES | INDEXES | CATALOG | DUMP t [limit [offset]] | VACUUM [t|all] | PLANS [n] | LOGS [n] | MEM | EXPLAIN select | HELP | EXIT"""


@dataclass
class Result:
    """What a statement gives: rows (a DataFrame, lazy) or a message, and how many rows it changed."""

    df: DataFrame | None = None
    message: str = ""
    changed: int = 0

    def rows(self) -> list[Row]:
        return self.df.collect() if self.df is not None else []


class Engine:
    """Opens what is under `root`. After a writer has died in a transaction, `recover` takes its lock away; what it
    had not committed is in no version, and VACUUM deletes it. A writer that lives after all can't commit any more.

    The plans of the latest queries are kept in the store with each commit and by `close`."""

    def __init__(self, spark: SparkSession, root: str, max_bytes: int | None = None, plan_history: int = 128, recover: bool = False):
        self.spark, self.store, self.max_bytes = spark, Store(spark, root), max_bytes
        if recover:
            self.store.take_over()
        self.committed: State = self.store.load()
        self.staged: State | None = None
        self.new: list[Segment] = []  # written by the open transaction
        self.external: dict[str, DataFrame] = {}
        self.plans: deque[str] = deque(self.store.read_history(), maxlen=plan_history)
        self.kept_plans = list(self.plans)

    # --- tables

    @property
    def state(self) -> State:
        return self.staged if self.staged is not None else self.committed

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame (of Parquet files, or a stream) known to queries; statements can't change it."""
        self.external[name.lower()] = df

    def table(self, name: str) -> DataFrame:
        if name.lower() in self.external:
            return self.external[name.lower()]
        return self.store.read(self.state.table(name))

    # --- statements

    def execute(self, text: str) -> Result:
        """One statement or command. What goes wrong is raised, and leaves the tables as they were."""
        command = self._command(text.strip().rstrip(";").strip())
        if command is not None:
            return command
        tree = parse(text)
        if isinstance(tree, (N.Select, N.SetOperation)):
            df = Compiler(self.table).query(tree).output()
            self._plan(text, df)
            return Result(df)
        rules: dict[type, Callable] = {N.Insert: self._insert, N.Update: self._update, N.Delete: self._delete, N.CreateTable: self._create_table, N.CreateIndex: self._create_index}
        return self._change(text, lambda: rules[type(tree)](tree))

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of a query."""
        found = self.execute(text)
        if found.df is None:
            raise SyntaxProblem("not a query")
        return found.df

    def run_plan(self, plan: PlanNode) -> DataFrame:
        """The DataFrame of a plan of the plan API."""

        def column(table: str, index: str) -> str:
            found = self.state.index(index)
            if found.table.lower() != table.lower():
                raise NameProblem(f"{index} is not an index of {table}")
            return found.column

        df = PlanExecutor(self.table, column).execute(plan)
        self._plan(plan.op, df)
        return df

    def explain(self, text: str) -> str:
        """The syntax tree of a query, and Spark's parsed, analyzed, optimized and physical plans."""
        tree = parse(text)
        return f"== Syntax Tree ==\n{N.outline(tree)}\n\n{self.sql(text)._jdf.queryExecution()}"

    def close(self) -> None:
        """Gives up an open transaction and keeps the plans for the next session."""
        if self.staged is not None:
            self.rollback()
        self._keep_plans()

    def _keep_plans(self) -> None:
        if list(self.plans) != self.kept_plans:
            self.kept_plans = list(self.plans)
            self.store.write_history(self.kept_plans)

    def _plan(self, what: str, df: DataFrame) -> None:
        plan = df._jdf.queryExecution()
        self.plans.append(f"{what.strip()}\n{plan.analyzed().toString() if df.isStreaming else plan.simpleString()}")

    # --- transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise TransactionProblem("a transaction is open")
        self.store.lock()
        self.committed = self.store.load()
        self.staged, self.new = copy.deepcopy(self.committed), []
        self.staged.transactions += 1

    def commit(self) -> None:
        """Publishes all that the transaction did, at once. If the store refuses it, the transaction is rolled back."""
        if self.staged is None:
            raise TransactionProblem("no transaction is open")
        self.staged.journal = self.staged.journal[-JOURNAL:]
        try:
            self.store.publish(self.staged)
        except TransactionProblem:
            self.rollback()
            self.committed = self.store.load()
            raise
        self.committed, self.staged, self.new = self.staged, None, []
        self.store.unlock()
        self._keep_plans()

    def rollback(self) -> None:
        if self.staged is None:
            raise TransactionProblem("no transaction is open")
        for s in self.new:
            self.store.drop(s)
        self.staged, self.new = None, []
        self.store.unlock()

    def _change(self, text: str, work: Callable[[], Result]) -> Result:
        """Runs a changing statement in the open transaction, or in one of its own; all of it holds, or nothing."""
        own = self.staged is None
        if own:
            self.begin()
        before, written = copy.deepcopy(self.staged), len(self.new)
        try:
            result = work()
            if self.max_bytes is not None and self.store.files.size("tables") > self.max_bytes:
                raise EngineError("the disk quota is used up")
        except Exception:
            for s in self.new[written:]:
                self.store.drop(s)
            self.staged, self.new = before, self.new[:written]
            if own:
                self.rollback()
            raise
        self.staged.journal.append({"time": time.time(), "transaction": self.staged.transactions, "statement": text.strip(), "changed": result.changed})
        if own:
            self.commit()
        return result

    # --- changes

    def _target(self, name: str) -> Table:
        if name.lower() in self.external:
            raise TypeProblem(f"{name} is read-only")
        return self.state.table(name)

    def _write(self, table: Table, df: DataFrame) -> Segment:
        segment = self.store.write(table, df, [i.column for i in self.state.indexes.values() if i.table.lower() == table.name.lower()])
        self.new.append(segment)
        return segment

    @staticmethod
    def _fit(column: ColumnDef, value: Column, kind: str) -> Column:
        """A value as the column stores it: cast (an error if it doesn't fit the type) and of bounded text length."""
        stored = value.cast(column.field.dataType)
        if kind == "double" and column.kind == "INT":
            stored = F.when(value == F.floor(value), stored).otherwise(F.raise_error(F.lit(f"{column.name} takes whole numbers")).cast("bigint"))
            stored = F.when(value.isNotNull(), stored)
        if column.kind == "DOUBLE":  # computed digits are not what the bound is for; literals are checked as they are written
            return stored
        long = F.octet_length(value.cast("string") if column.kind == "STRING" else stored.cast("string")) > column.length
        return F.when(long, F.raise_error(F.lit(f"a value of {column.name} is longer than {column.length}")).cast(column.field.dataType)).otherwise(stored)

    def _insert(self, s: N.Insert) -> Result:
        table = self._target(s.table)
        if s.query is not None:
            r = Compiler(self.table).query(s.query)
            if len(r.fields) != len(table.columns):
                raise TypeProblem(f"{table.name} has {len(table.columns)} columns")
            df = r.df.select(*(self._fit(c, f.column, kind_of(f.type)).alias(c.name) for c, f in zip(table.columns, r.fields, strict=True)))
        else:
            df = self.spark.createDataFrame([self._row(table, row) for row in s.rows], table.schema).coalesce(1)
        segment = self._write(table, df)
        table.segments.append(segment)
        table.version += 1
        return Result(message=f"{segment.rows} rows inserted", changed=segment.rows)

    @staticmethod
    def _row(table: Table, row: tuple[N.Literal, ...]) -> tuple:
        if len(row) != len(table.columns):
            raise TypeProblem(f"{table.name} has {len(table.columns)} columns, {len(row)} values given")
        out = []
        for c, literal in zip(table.columns, row, strict=True):
            v = literal.value
            if v is not None:
                if len(str(v).encode()) > c.length:
                    raise TypeProblem(f"a value of {c.name} is longer than {c.length}")
                try:
                    if c.kind == "INT" and isinstance(v, float) and not v.is_integer():
                        raise ValueError
                    v = {"INT": int, "DOUBLE": float, "STRING": str}[c.kind](v)
                except ValueError:
                    raise TypeProblem(f"{c.name} is {c.kind}, got {v!r}") from None
            out.append(v)
        return tuple(out)

    def _touched(self, table: Table, where: object) -> tuple[set[tuple[str, str]], int]:
        """The files with rows that match, and how many rows do: the matching is left to the executors."""
        df = self.store.read(table)
        if not table.segments:
            return set(), 0
        r = R.scan(df.select("*", F.col("_metadata.file_path").alias("__file")), table.name)
        matched = R.filtered(r, Expressions(r).condition(where))
        counts = matched.df.groupBy(r.fields[-1].column.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per touched file
        return {tuple(unquote(c["f"]).rsplit("/", 2)[1:]) for c in counts}, sum(c["n"] for c in counts)

    def _rewrite(self, table: Table, touched: set[tuple[str, str]] | None, make: Callable[[R.Relation], DataFrame]) -> None:
        """Puts the result of `make` over the touched files (None: all, which need not be listed) in their place."""
        if touched is None:
            segment = self._write(table, make(R.scan(self.store.read(table), table.name)))
            table.segments = [segment] if segment.rows else []
            table.version += 1
            return
        paths = [f"{self.store.files.root}/{s.path}/{n}" for s in table.segments for n in self.store.names(s) if (s.path.rsplit("/", 1)[1], n) in touched]
        df = self.spark.read.schema(table.schema).parquet(*paths)
        segment = self._write(table, make(R.scan(df, table.name)))
        left = self.store.without(table, touched)
        table.segments = [*left, segment] if segment.rows else left
        table.version += 1

    def _update(self, s: N.Update) -> Result:
        table = self._target(s.table)
        empty = R.scan(self.spark.createDataFrame([], table.schema), table.name)
        names = [empty.find(name).name for name, _ in s.assignments]
        if len(set(names)) != len(names):
            raise NameProblem("a column is set twice")
        if s.where is None:
            touched, n = None, sum(x.rows for x in table.segments)
        else:
            touched, n = self._touched(table, s.where)

        def make(r: R.Relation) -> DataFrame:
            over = Expressions(r)
            matched = F.lit(True) if s.where is None else F.coalesce(over.condition(s.where), F.lit(False))
            put = dict(zip(names, (e for _, e in s.assignments), strict=True))
            out = []
            for c in table.columns:
                old = r.find(c.name)
                out.append((F.when(matched, self._fit(c, *over(put[c.name]))).otherwise(old.column) if c.name in put else old.column).alias(c.name))
            return r.df.select(*out)  # all right-hand sides see the old row

        if n:
            self._rewrite(table, touched, make)
        return Result(message=f"{n} rows updated", changed=n)

    def _delete(self, s: N.Delete) -> Result:
        table = self._target(s.table)
        if s.where is None:
            n, table.segments = sum(x.rows for x in table.segments), []
            table.version += 1
            return Result(message=f"{n} rows deleted", changed=n)
        touched, n = self._touched(table, s.where)
        if n:
            self._rewrite(table, touched, lambda r: R.filtered(r, ~F.coalesce(Expressions(r).condition(s.where), F.lit(False))).output())
        return Result(message=f"{n} rows deleted", changed=n)

    def _create_table(self, s: N.CreateTable) -> Result:
        if s.table.lower() in self.state.tables or s.table.lower() in self.external:
            raise NameProblem(f"table {s.table} exists")
        table = Table(s.table, list(s.columns))
        _ = table.schema  # checks the columns
        self.state.tables[s.table.lower()] = table
        return Result(message=f"table {s.table} created")

    def _create_index(self, s: N.CreateIndex) -> Result:
        """An index is how files are written: sorted, with Bloom filters; those there are written again."""
        if s.index.lower() in self.state.indexes:
            raise NameProblem(f"index {s.index} exists")
        table = self._target(s.table)
        found = [c for c in table.columns if c.name.lower() == s.column.lower()]
        if not found:
            raise NameProblem(f"no column {s.column}")
        self.state.indexes[s.index.lower()] = Index(s.index, table.name, found[0].name)
        if table.segments:
            segment = self._write(table, self.store.read(table))
            table.segments = [segment]
            table.version += 1
        return Result(message=f"index {s.index} created")

    # --- commands

    def _command(self, text: str) -> Result | None:
        words = text.split()
        head = words[0].upper() if words else ""
        simple: dict[str, Callable[[], Result]] = {
            "BEGIN": lambda: (self.begin(), Result(message="transaction begun"))[1],
            "COMMIT": lambda: (self.commit(), Result(message="committed"))[1],
            "ROLLBACK": lambda: (self.rollback(), Result(message="rolled back"))[1],
            "TABLES": lambda: Result(self.tables()),
            "INDEXES": lambda: Result(self.indexes()),
            "CATALOG": lambda: Result(self.system_catalog()),
            "MEM": lambda: Result(self.memory()),
            "HELP": lambda: Result(message=HELP),
        }
        if len(words) == 1 and head in simple:
            return simple[head]()
        if head in ("PLANS", "LOGS") and len(words) <= 2:
            n = self._number(words[1]) if len(words) == 2 else None
            return Result(message="\n".join(self.history(n) if head == "PLANS" else self.log(n)))
        if head == "DUMP" and 2 <= len(words) <= 4:
            limit, offset = [*(self._number(w) for w in words[2:]), 0, 0][:2]
            total = self.count(words[1])
            shown = max(0, min(total - offset, limit or total))
            more = "\nResult truncated; more rows are available." if offset + shown < total else ""
            return Result(self.dump(words[1], limit, offset), f"Total records: {total}{more}")
        if head == "VACUUM" and len(words) <= 2:
            found = self.vacuum(words[1] if len(words) == 2 and words[1].lower() != "all" else None)
            return Result(message="\n".join(f"{t}: {', '.join(f'{k} {v}' for k, v in x.items())}" for t, x in found.items()))
        if head == "EXPLAIN" and len(words) > 1:
            return Result(message=self.explain(text[len("EXPLAIN") :]))
        return None

    @staticmethod
    def _number(word: str) -> int:
        if not re.fullmatch(r"\d+", word):
            raise SyntaxProblem(f"{word!r} is not a number")
        return int(word)

    def tables(self) -> DataFrame:
        rows = [(t.name, c.name, c.kind, c.length, t.version, sum(s.rows for s in t.segments), len(t.segments)) for t in self.state.tables.values() for c in t.columns]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, type string, length long, version long, records long, segments long")

    def indexes(self) -> DataFrame:
        rows = [(i.name, i.table, i.column, i.unique) for i in self.state.indexes.values()]
        return self.spark.createDataFrame(rows, "index_name string, table_name string, column_name string, is_unique boolean")

    def system_catalog(self) -> DataFrame:
        """The catalog as two system tables in one: SYS_TABLES and SYS_INDEXES with a line of text for each entry."""
        rows = [("SYS_TABLES", t.name, ", ".join(f"{c.name}:{c.kind}:{c.length}" for c in t.columns) + f" records={sum(s.rows for s in t.segments)}") for t in self.state.tables.values()]
        rows += [("SYS_INDEXES", i.name, f"{i.table}({i.column}) unique={i.unique}") for i in self.state.indexes.values()]
        return self.spark.createDataFrame(rows, "catalog string, name string, description string")

    def flush(self) -> None:
        """Nothing is held back: a commit is in the store when it returns."""

    def describe_index(self, name: str) -> list[str]:
        """The files that an index is in, with their sizes."""
        table = self.state.table(self.state.index(name).table)
        return [f"{u.rsplit('/', 1)[1]} {n}" for s in table.segments for u, d, n in self.store.files.list(s.path) if not d and u.endswith(".parquet")]

    def count(self, table: str) -> int:
        """The records of a table: from the catalog, or counted if it is a registered one."""
        return self.table(table).count() if table.lower() in self.external else sum(s.rows for s in self.state.table(table).segments)

    def dump(self, table: str, limit: int = 0, offset: int = 0) -> DataFrame:
        """The rows of a table with their number, and the file and the place in it where each is; limit 0 is all.

        Rows of the engine's tables come in the order of their files and are numbered from offset + 1; those of
        registered ones have no order and no number.
        """
        df = self.table(table)
        if table.lower() in self.external:
            df = df.offset(offset) if offset else df
            return df.limit(limit) if limit else df
        if not self.state.table(table).segments:
            return df.select(F.lit(None).cast("long").alias("row_number"), "*", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("long").alias("row_index"))
        df = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
        # rows before each file: one row per file, so the window is over few
        files = df.groupBy("__path").agg(F.count(F.lit(1)).alias("__n"))
        before = files.select("__path", (F.sum("__n").over(Window.orderBy("__path")) - F.col("__n")).alias("__before"))
        df = df.join(before, "__path").withColumn("row_number", F.col("__before") + F.col("row_index") + 1)
        df = df.filter(F.col("row_number") > offset) if offset else df
        df = df.filter(F.col("row_number") <= offset + limit) if limit else df
        columns = [c.name for c in self.state.table(table).columns]
        return df.select("row_number", *columns, "file_name", "row_index").orderBy("row_number")

    def vacuum(self, table: str | None = None, most_segments: int = 16) -> dict[str, dict[str, int]]:
        """Deletes what no version names. A table of more than `most_segments` segments is written again as one."""
        if self.staged is not None:
            raise TransactionProblem("VACUUM is not possible in a transaction")
        self.begin()
        try:
            names = [self.state.table(table).name] if table else [t.name for t in self.state.tables.values()]
            compacted = {}
            for t in map(self.state.table, names):
                compacted[t.name] = len(t.segments) if len(t.segments) > most_segments else 0
                if compacted[t.name]:
                    segment = self._write(t, self.store.read(t))
                    t.segments, t.version = [segment], t.version + 1
            if any(compacted.values()):
                self.store.publish(self.staged)
                self.committed = self.staged
            found = {t.name: self.store.vacuum(t) | {"compacted": compacted[t.name]} for t in map(self.state.table, names)}
            self.staged, self.new = None, []
            return found
        finally:
            if self.staged is not None:
                self.rollback()
            self.store.unlock()

    def history(self, n: int | None = None) -> list[str]:
        """The plans of the latest queries; older ones give way."""
        found = list(self.plans)
        return found if n is None else found[len(found) - min(n, len(found)) :]

    def log(self, n: int | None = None) -> list[str]:
        found = [f"#{x['transaction']} {x['statement']} ({x['changed']} rows)" for x in self.state.journal]
        return found if n is None else found[len(found) - min(n, len(found)) :]

    def memory(self) -> DataFrame:
        conf = self.spark.sparkContext.getConf()
        rows = [(k, conf.get(k, d)) for k, d in (("spark.executor.memory", "1g"), ("spark.driver.memory", "1g"), ("spark.memory.fraction", "0.6"), ("spark.memory.storageFraction", "0.5"))]
        return self.spark.createDataFrame(rows, "setting string, value string")


def render(df: DataFrame) -> str:
    """A result as a grid of text, with its number of rows; they are fetched one partition at a time."""
    rows = [["NULL" if v is None else str(v) for v in r] for r in df.toLocalIterator()]
    widths = [max(10, *(len(x) for x in column)) for column in zip(df.columns, *rows, strict=True)] if rows else [max(10, len(c)) for c in df.columns]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)) + "|"
    return "\n".join([rule, line(df.columns), rule, *map(line, rows), rule, f"({len(rows)} rows)"])
