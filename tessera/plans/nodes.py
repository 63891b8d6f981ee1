"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str  # - or NOT
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str  # upper case
    argument: object
    distinct: bool = False


@dataclass(frozen=True)
class In:
    operand: object
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool = False


@dataclass(frozen=True)
class Item:
    expression: object
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str  # inner, left, right, full, cross, left_semi or left_anti
    condition: object | None = None


@dataclass(frozen=True)
class SortKey:
    key: Name
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: object
    where: object | None = None
    group_by: tuple[Name, ...] = ()
    having: object | None = None
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class SetOperation:
    op: str  # UNION, UNION ALL, INTERSECT or EXCEPT
    left: object
    right: object
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple, ...] = ()
    query: object | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, object], ...]
    where: object | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    column: str


_OPERATORS = {"=", "<>", "<", "<=", ">", ">=", "AND", "OR", "+", "-", "*", "/", "%", "LIKE"}


def text(e: object) -> str:
    """An expression as it is printed in default column names: operators in parentheses."""
    match e:
        case Literal(None):
            return "NULL"
        case Literal(str() as v):
            return f"'{v}'"
        case Literal(v):
            return str(v)
        case Name(name, table):
            return f"{table}.{name}" if table else name
        case Star():
            return "*"
        case Unary(op, x):
            return f"({op} {text(x)})" if op == "NOT" else f"({op}{text(x)})"
        case Binary(op, a, b) if op in _OPERATORS:
            return f"({text(a)} {op} {text(b)})"
        case Call(name, x, distinct):
            return f"{name}({'DISTINCT ' if distinct else ''}{text(x)})"
        case In(x, values, negated):
            return f"({text(x)} {'NOT ' if negated else ''}IN ({', '.join(map(text, values))}))"
        case IsNull(x, negated):
            return f"({text(x)} IS {'NOT ' if negated else ''}NULL)"
    raise TypeError(f"no expression: {e!r}")


def outline(tree: object, name: str = "", depth: int = 0) -> str:
    """A tree with a line for each node and leaf, indented."""
    head = "  " * depth + (f"{name}: " if name else "")
    if is_dataclass(tree):
        own = [(f.name, getattr(tree, f.name)) for f in fields(tree)]
        return "\n".join([head + type(tree).__name__, *(outline(v, k, depth + 1) for k, v in own if v not in (None, (), False))])
    if isinstance(tree, tuple):
        return "\n".join([head.rstrip(), *(outline(v, "", depth + 1) for v in tree)])
    return f"{head}{tree!r}"
