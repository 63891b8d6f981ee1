"""Column types of the dialect: INT, DOUBLE and STRING, each with a largest length of its text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import TypeProblem

_DEFAULT_LENGTH = {"INT": 16, "DOUBLE": 16, "STRING": 64}
_SPARK = {"INT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str  # INT, DOUBLE or STRING
    length: int

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, _SPARK[self.kind], True, {"length": self.length})


def column(name: str, token: str, length: int = 0) -> ColumnDef:
    """A column from DDL: int and integer are INT, double is DOUBLE, any other token is STRING; length 0 is the default."""
    word = token.upper()
    kind = "INT" if word in ("INT", "INTEGER") else "DOUBLE" if word == "DOUBLE" else "STRING"
    if length < 0:
        raise TypeProblem(f"column {name}: the length must be positive")
    return ColumnDef(name, kind, length or _DEFAULT_LENGTH[kind])


def schema(columns: list[ColumnDef]) -> T.StructType:
    if not columns:
        raise TypeProblem("a table needs a column")
    names = [c.name.lower() for c in columns]
    if len(set(names)) != len(names):
        raise TypeProblem("a column name is used twice")
    return T.StructType([c.field for c in columns])


def kind_of(data_type: T.DataType) -> str:
    """int, double, string, boolean, null or other, for the dialect's rules."""
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.FractionalType):
        return "double"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "null" if isinstance(data_type, T.NullType) else "other"
