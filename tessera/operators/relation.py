"""Relations: a DataFrame whose columns have internal names, and the names by which statements know them.

Every scan renames its columns to names of its own, so joins of a table with itself and columns of the same name need
no care further up; Catalyst folds the renames away, and filters and columns reach the Parquet scan.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NameProblem

_NUMBERS = itertools.count()


@dataclass(frozen=True)
class Field:
    name: str
    internal: str
    type: T.DataType
    tables: tuple[str, ...] = ()  # qualifiers, lower case

    @property
    def column(self) -> Column:
        return F.col(self.internal)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    fields: tuple[Field, ...]

    def find(self, name: str, table: str | None = None) -> Field:
        """The column of that name. Names don't depend on case; one that fits several columns is an error."""
        found = [f for f in self.fields if f.name.lower() == name.lower() and (table is None or table.lower() in f.tables)]
        shown = f"{table}.{name}" if table else name
        if not found:
            raise NameProblem(f"no column {shown}")
        if len(found) > 1:
            raise NameProblem(f"column {shown} is ambiguous")
        return found[0]

    def output(self) -> DataFrame:
        return self.df.select(*(f.column.alias(f.name) for f in self.fields))


def scan(df: DataFrame, table: str | None = None) -> Relation:
    """A relation over a DataFrame's columns."""
    n = next(_NUMBERS)
    fields = tuple(Field(f.name, f"r{n}_{i}", f.dataType, (table.lower(),) if table else ()) for i, f in enumerate(df.schema))
    return Relation(df.toDF(*(f.internal for f in fields)), fields)


def alias(r: Relation, name: str) -> Relation:
    """The relation under another name; the names that its columns had stay as synonyms."""
    return Relation(r.df, tuple(replace(f, tables=(name.lower(), *(t for t in f.tables if t != name.lower()))) for f in r.fields))


def join(left: Relation, right: Relation, kind: str, condition: Column | None, hint: str | None = None) -> Relation:
    """Joins; Catalyst takes equalities out of the condition and picks broadcast, sort-merge or nested loop by size."""
    other = right.df.hint(hint) if hint else right.df
    if kind == "cross" and condition is None:
        df = left.df.crossJoin(other)
    else:
        df = left.df.join(other, condition, "inner" if kind == "cross" else kind)
    return Relation(df, left.fields if kind in ("left_semi", "left_anti") else left.fields + right.fields)


def filtered(r: Relation, condition: Column) -> Relation:
    return Relation(r.df.filter(condition), r.fields)


def project(r: Relation, columns: list[tuple[str, Column, tuple[str, ...]]]) -> Relation:
    """(name, column, qualifiers) for each output column."""
    n = next(_NUMBERS)
    df = r.df.select(*(c.alias(f"r{n}_{i}") for i, (_, c, _) in enumerate(columns)))
    return Relation(df, tuple(Field(name, f.name, f.dataType, tables) for (name, _, tables), f in zip(columns, df.schema, strict=True)))


def aggregate(r: Relation, keys: list[Field], measures: list[tuple[str, Column]]) -> Relation:
    """Group columns first, then the measures; partial aggregation before the shuffle is Spark's own."""
    n = next(_NUMBERS)
    named = [c.alias(f"r{n}_{i}") for i, (_, c) in enumerate(measures)]
    if not named:
        df = r.df.select(*(k.column for k in keys)).distinct()
    else:
        df = r.df.groupBy(*(k.column for k in keys)).agg(*named) if keys else r.df.agg(*named)
    types = {f.name: f.dataType for f in df.schema}
    return Relation(df, (*keys, *(Field(name, f"r{n}_{i}", types[f"r{n}_{i}"]) for i, (name, _) in enumerate(measures))))


def distinct(r: Relation) -> Relation:
    return Relation(r.df.distinct(), r.fields)


def sort(r: Relation, keys: list[tuple[Field, bool]]) -> Relation:
    """(column, descending) keys; nulls are lowest."""
    return Relation(r.df.orderBy(*(k.column.desc() if down else k.column.asc() for k, down in keys)), r.fields)


def limit(r: Relation, n: int | None, offset: int = 0) -> Relation:
    df = r.df.offset(offset) if offset else r.df
    return Relation(df if n is None else df.limit(n), r.fields)


def combine(op: str, left: Relation, right: Relation) -> Relation:
    """UNION, UNION ALL, INTERSECT and EXCEPT by position; the names are those on the left."""
    if len(left.fields) != len(right.fields):
        raise NameProblem(f"{op} needs as many columns on either side")
    a = left.df.select(*(f.column for f in left.fields))
    b = right.df.select(*(f.column for f in right.fields))
    df = {"UNION": lambda: a.union(b).distinct(), "UNION ALL": lambda: a.union(b), "INTERSECT": lambda: a.intersect(b), "EXCEPT": lambda: a.subtract(b)}[op]()
    return scan(df.toDF(*(f.name for f in left.fields)))
