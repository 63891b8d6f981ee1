"""Syntax trees to DataFrames, by the Column API alone: Catalyst gets the whole plan and optimizes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NameProblem, SyntaxProblem, TypeProblem
from ..functions.aggregates import AGGREGATES, NUMERIC, is_aggregate
from ..operators import relation as R
from ..types import kind_of
from . import nodes as N

Resolve = Callable[[str], DataFrame]
_NUMERIC = ("int", "double", "null")
_KIND_TYPES = {"int": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "null": T.NullType()}


class Expressions:
    """Compiles expressions over a relation; `known` holds expressions that are columns already, as aggregates are."""

    def __init__(self, relation: R.Relation, known: dict[object, R.Field] | None = None):
        self.relation, self.known = relation, known or {}

    def __call__(self, e: object) -> tuple[Column, str]:
        """The column and its kind: int, double, string, boolean, null or other."""
        if e in self.known:
            f = self.known[e]
            return f.column, kind_of(f.type)
        match e:
            case N.Literal(None):
                return F.lit(None), "null"
            case N.Literal(bool() as v):
                return F.lit(v), "boolean"
            case N.Literal(int() as v):
                return F.lit(v), "int"
            case N.Literal(float() as v):
                return F.lit(v), "double"
            case N.Literal(v):
                return F.lit(v), "string"
            case N.Name(name, table):
                f = self.relation.find(name, table)
                return f.column, kind_of(f.type)
            case N.Unary("NOT", x):
                return ~self.condition(x), "boolean"
            case N.Unary(_, x):
                c, kind = self(x)
                self._numeric("-", kind)
                return -c, kind
            case N.IsNull(x, negated):
                c, _ = self(x)
                return (c.isNotNull() if negated else c.isNull()), "boolean"
            case N.In(x, values, negated):
                found = self._in(x, values)
                return (~found if negated else found), "boolean"
            case N.Binary("AND", a, b):
                return self.condition(a) & self.condition(b), "boolean"
            case N.Binary("OR", a, b):
                return self.condition(a) | self.condition(b), "boolean"
            case N.Binary("LIKE", a, b):
                (x, kx), (y, ky) = self(a), self(b)
                if kx not in ("string", "null") or ky not in ("string", "null"):
                    raise TypeProblem("LIKE compares strings")
                return F.like(x, y), "boolean"
            case N.Binary(op, a, b) if op in ("=", "<>", "<", "<=", ">", ">="):
                x, y = self._alike(a, b)
                return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "boolean"
            case N.Binary(op, a, b):
                return self._arithmetic(op, self(a), self(b))
            case N.Call(name):
                raise SyntaxProblem(f"{name}(...) is not allowed here" if is_aggregate(name) else f"no function {name}")
        raise SyntaxProblem(f"{N.text(e)} is not allowed here")

    def condition(self, e: object) -> Column:
        c, kind = self(e)
        if kind not in ("boolean", "null"):
            raise TypeProblem(f"{N.text(e)} is not a condition")
        return c.cast("boolean") if kind == "null" else c

    def _in(self, x: object, values: tuple) -> Column:
        """One set test, however many values there are. A NULL among them makes a miss NULL, as with = and OR."""
        found = F.lit(False)
        known = [v for v in values if v.value is not None]
        if known:
            pairs = [self._alike(x, v) for v in known]
            found = pairs[0][0].isin(*(v for _, v in pairs))
        return found if len(known) == len(values) else found | F.lit(None).cast("boolean")

    def _alike(self, a: object, b: object) -> tuple[Column, Column]:
        """Both sides of a comparison. A number beside a string literal makes the literal a number; else kinds must agree."""
        (x, kx), (y, ky) = self(a), self(b)
        for this, other, literal in ((kx, ky, b), (ky, kx, a)):
            if this in ("int", "double") and other == "string":
                if not isinstance(literal, N.Literal):
                    raise TypeProblem(f"{N.text(a)} and {N.text(b)} are a number and a string")
                try:
                    number = float(literal.value)
                except ValueError:
                    raise TypeProblem(f"{literal.value!r} is not a number") from None
                c = F.lit(int(number) if number.is_integer() and "." not in literal.value else number)
                return (x, c) if literal is b else (c, y)
        if "other" not in (kx, ky) and "null" not in (kx, ky) and kx != ky and not {kx, ky} <= {"int", "double"}:
            raise TypeProblem(f"{N.text(a)} and {N.text(b)} can't be compared")
        return x, y

    @staticmethod
    def _numeric(op: str, *kinds: str) -> None:
        if any(k not in _NUMERIC for k in kinds):
            raise TypeProblem(f"{op} needs numbers")

    def _arithmetic(self, op: str, left: tuple[Column, str], right: tuple[Column, str]) -> tuple[Column, str]:
        (x, kx), (y, ky) = left, right
        self._numeric(op, kx, ky)
        kind = "double" if "double" in (kx, ky) else "int"
        if kind == "int":  # 64-bit whole numbers; division truncates
            x, y = x.cast("bigint"), y.cast("bigint")
            if op == "/":
                return F.call_function("div", x, y), kind
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op](), kind


def _calls(e: object, found: dict[N.Call, None]) -> None:
    """The aggregate calls in an expression, in order."""
    match e:
        case N.Call(name, x):
            if not is_aggregate(name):
                raise SyntaxProblem(f"no function {name}")
            inner: dict[N.Call, None] = {}
            _calls(x, inner)
            if inner:
                raise SyntaxProblem("an aggregate inside an aggregate")
            found[e] = None
        case N.Unary(_, x) | N.IsNull(x) | N.In(x):
            _calls(x, found)
        case N.Binary(_, a, b):
            _calls(a, found)
            _calls(b, found)


def measure(call: N.Call, expressions: Expressions) -> Column:
    """The aggregate column of a call."""
    name = call.name.upper()
    if isinstance(call.argument, N.Star):
        if name != "COUNT" or call.distinct:
            raise SyntaxProblem(f"{name}(*) is not in the dialect")
        return F.count(F.lit(1))
    c, kind = expressions(call.argument)
    if name in NUMERIC and kind not in _NUMERIC:
        raise TypeProblem(f"{name} needs numbers")
    if call.distinct:
        special = {"COUNT": F.count_distinct, "SUM": F.sum_distinct, "MIN": F.min, "MAX": F.max}
        if name not in special:
            raise SyntaxProblem(f"{name}(DISTINCT ...) is not in the dialect")
        return special[name](c)
    return AGGREGATES[name](c)


def _bare_names(e: object, inside: bool = False) -> list[N.Name]:
    """The names in an expression outside aggregate calls."""
    match e:
        case N.Name():
            return [e]
        case N.Unary(_, x) | N.IsNull(x) | N.In(x):
            return _bare_names(x)
        case N.Binary(_, a, b):
            return _bare_names(a) + _bare_names(b)
    return []


class Compiler:
    """Compiles queries; `resolve` gives the DataFrame of a table."""

    def __init__(self, resolve: Resolve):
        self.resolve = resolve

    def query(self, q: object) -> R.Relation:
        if isinstance(q, N.Select):
            return self._select(q)
        if isinstance(q, N.SetOperation):
            r = R.combine(q.op, self.query(q.left), self.query(q.right))
            if q.order_by:
                r = R.sort(r, [(r.find(k.key.name, k.key.table), k.descending) for k in q.order_by])
            return R.limit(r, q.limit, q.offset)
        raise SyntaxProblem("not a query")

    def _source(self, s: object) -> R.Relation:
        match s:
            case N.TableRef(name, alias):
                r = R.scan(self.resolve(name), name)
                return R.alias(r, alias) if alias else r
            case N.Derived(query, alias):
                r = self.query(query)
                return R.alias(r, alias) if alias else r
            case N.Join(left, right, kind, condition):
                a, b = self._source(left), self._source(right)
                both = R.Relation(a.df, a.fields + b.fields)
                shared = {t for f in a.fields for t in f.tables[:1]} & {t for f in b.fields for t in f.tables[:1]}
                if shared:
                    raise NameProblem(f"{shared.pop()} is named twice; give one an alias")
                return R.join(a, b, kind, None if condition is None else Expressions(both).condition(condition))
        raise SyntaxProblem("not a source")

    def _select(self, q: N.Select) -> R.Relation:
        r = self._source(q.source)
        if q.where is not None:
            r = R.filtered(r, Expressions(r).condition(q.where))
        items = list(q.items)
        star = any(isinstance(i.expression, N.Star) for i in items)
        calls: dict[N.Call, None] = {}
        for i in items:
            _calls(i.expression, calls)
        if q.having is not None:
            _calls(q.having, calls)
        if star and (calls or q.group_by):
            raise SyntaxProblem("* can't stand beside aggregates or GROUP BY")
        if star:  # a star anywhere in the list is the whole list
            items = [N.Item(N.Name(f.name, f.internal)) for f in r.fields]
            r = R.Relation(r.df, tuple(replace(f, tables=(*f.tables, f.internal)) for f in r.fields))
        if calls or q.group_by or q.having is not None:
            return self._grouped(q, items, r, list(calls))
        return self._finish(q, items, r, Expressions(r))

    def _grouped(self, q: N.Select, items: list[N.Item], r: R.Relation, calls: list[N.Call]) -> R.Relation:
        expressions = Expressions(r)
        names = list(q.group_by) or [n for i in items for n in _bare_names(i.expression)]  # without GROUP BY: the bare columns
        keys = list({(f := r.find(n.name, n.table)).internal: f for n in names}.values())
        grouped = R.aggregate(r, keys, [(N.text(c), measure(c, expressions)) for c in calls])
        known = dict(zip(calls, grouped.fields[len(keys) :], strict=True))
        visible = R.Relation(grouped.df, tuple(keys))
        over = Expressions(visible, known)
        if q.having is not None:
            aliases = {i.alias.lower(): i.expression for i in items if i.alias}

            def named(e: object) -> object:
                match e:
                    case N.Name(name, None) if name.lower() in aliases and not any(f.name.lower() == name.lower() for f in keys):
                        return aliases[name.lower()]
                    case N.Unary(op, x):
                        return N.Unary(op, named(x))
                    case N.IsNull(x, negated):
                        return N.IsNull(named(x), negated)
                    case N.In(x, values, negated):
                        return N.In(named(x), values, negated)
                    case N.Binary(op, a, b):
                        return N.Binary(op, named(a), named(b))
                return e

            visible = R.filtered(visible, over.condition(named(q.having)))
            over = Expressions(visible, known)
        return self._finish(q, items, visible, over)

    def _finish(self, q: N.Select, items: list[N.Item], r: R.Relation, expressions: Expressions) -> R.Relation:
        """Projection, DISTINCT, ORDER BY (by output names or by columns below) and LIMIT."""
        columns = []
        for i in items:
            c, kind = expressions(i.expression)
            tables: tuple[str, ...] = ()
            if isinstance(i.expression, N.Name):
                f = r.find(i.expression.name, i.expression.table)
                name, tables = f.name, f.tables
            else:
                name = N.text(i.expression)
            if kind == "null":
                c = c.cast("string")
            columns.append((i.alias or name, c, tables))
        n = len(columns)
        below: dict[str, R.Field] = {}
        if q.order_by and not q.distinct:
            for k in q.order_by:
                if sum(name.lower() == k.key.name.lower() and (k.key.table is None or k.key.table.lower() in t) for name, _, t in columns) != 1:
                    f = r.find(k.key.name, k.key.table)
                    below[f.internal] = f
        out = R.project(r, [*columns, *((f.name, f.column, f.tables) for f in below.values())])
        shown = R.Relation(out.df, out.fields[:n])
        if q.distinct:
            out = shown = R.distinct(shown)
        if q.order_by:
            hidden = dict(zip(below, out.fields[n:], strict=True))
            keys = []
            for k in q.order_by:
                try:
                    f = shown.find(k.key.name, k.key.table)
                except NameProblem:
                    if q.distinct:
                        raise
                    f = hidden[r.find(k.key.name, k.key.table).internal]
                keys.append((f, k.descending))
            out = R.sort(out, keys)
        limited = R.limit(R.Relation(out.df, shown.fields), q.limit, q.offset)
        return R.Relation(limited.df.select(*(f.column for f in limited.fields)), limited.fields)
