"""The programmatic plan API: trees of PlanNode with string parameters, interpreted as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import SyntaxProblem
from ..functions.aggregates import is_aggregate
from ..plans import nodes as N
from ..plans.compiler import Expressions, measure
from ..plans.parser import parse_expression
from . import relation as R

_CALL = re.compile(r"\s*(\w+)\s*\((.*)\)\s*(?:(?:AS\s+|=\s*)?(\w+))?\s*\Z", re.I | re.S)


@dataclass(frozen=True)
class PlanNode:
    op: str
    params: dict[str, str] = field(default_factory=dict)
    children: tuple[PlanNode, ...] = ()
    output_columns: tuple[str, ...] = ()


def _split(text: str, separators: str = ",;") -> list[str]:
    """The parts of a list, cut at separators outside parentheses and quotes."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c in separators and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in (*parts, text[last:]) if p.strip()]


def _name(text: str) -> N.Name:
    e = parse_expression(text)
    if not isinstance(e, N.Name):
        raise SyntaxProblem(f"{text!r} is not a column")
    return e


def _argument(text: str) -> object:
    return N.Star() if text.strip() == "*" else parse_expression(text)


def aggregate_spec(text: str) -> tuple[N.Call, str | None]:
    """FUNC(expr) [AS] alias, FUNC(expr)=alias, FUNC:expr:alias, FUNC expr, or FUNC alone (over all rows)."""
    if (m := _CALL.match(text)) and is_aggregate(m[1]):
        return N.Call(m[1].upper(), _argument(m[2])), m[3]
    if ":" in text:
        name, argument, *alias = (p.strip() for p in text.split(":"))
    else:
        name, _, argument = text.strip().partition(" ")
        alias = []
    if not is_aggregate(name):
        raise SyntaxProblem(f"{text!r} is not an aggregate")
    return N.Call(name.upper(), _argument(argument or "*")), (alias[0] if alias and alias[0] else None)


def _first(params: dict[str, str], *names: str) -> str:
    return next((params[n] for n in names if params.get(n)), "")


class PlanExecutor:
    """Interprets plans; `resolve` gives the DataFrame of a table and `index_column` that of (table, index)."""

    def __init__(self, resolve: Callable[[str], DataFrame], index_column: Callable[[str, str], str]):
        self.resolve, self.index_column = resolve, index_column

    def execute(self, plan: PlanNode) -> DataFrame:
        return self.relation(plan).output()

    def relation(self, plan: PlanNode) -> R.Relation:
        rule = getattr(self, f"_{plan.op.lower()}", None)
        if rule is None:
            raise SyntaxProblem(f"no operator {plan.op}")
        return rule(plan, *(self.relation(c) for c in plan.children))

    def _need(self, plan: PlanNode, name: str) -> str:
        if not plan.params.get(name):
            raise SyntaxProblem(f"{plan.op} needs {name}")
        return plan.params[name]

    def _table_scan(self, plan: PlanNode) -> R.Relation:
        table = self._need(plan, "table")
        return R.scan(self.resolve(table), table)

    def _index_scan(self, plan: PlanNode) -> R.Relation:
        """All rows with that key, by a filter that the Parquet scan takes over (statistics and Bloom filters)."""
        table = self._need(plan, "table")
        r = R.scan(self.resolve(table), table)
        key = N.Literal(plan.params["key"])
        column = N.Name(self.index_column(table, self._need(plan, "index")))
        return R.filtered(r, Expressions(r).condition(N.Binary("=", column, key)))

    def _filter(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        return R.filtered(r, Expressions(r).condition(parse_expression(self._need(plan, "condition"))))

    def _projection(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        names = list(plan.output_columns) or _split(plan.params.get("columns", ""))
        if not names:
            raise SyntaxProblem("PROJECTION needs columns")
        fields = [r.find(n.name, n.table) for n in map(_name, names)]
        return R.project(r, [(f.name, f.column, f.tables) for f in fields])

    def _joined(self, plan: PlanNode, a: R.Relation, b: R.Relation, hint: str | None) -> R.Relation:
        kind = plan.params.get("join_type", "inner").lower().removesuffix(" outer")
        both = Expressions(R.Relation(a.df, a.fields + b.fields))
        parts = []
        if plan.params.get("left_key") and plan.params.get("right_key"):
            parts.append(Expressions(a)(_name(plan.params["left_key"]))[0] == Expressions(b)(_name(plan.params["right_key"]))[0])
        if plan.params.get("condition"):
            parts.append(both.condition(parse_expression(plan.params["condition"])))
        condition = None
        for p in parts:
            condition = p if condition is None else condition & p
        return R.join(a, b, "cross" if condition is None else kind, condition, hint)

    def _nested_loop_join(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return self._joined(plan, a, b, None)

    def _hash_join(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return self._joined(plan, a, b, None)  # broadcast or shuffled hash, or sort-merge if it doesn't fit: Spark sees the sizes

    def _merge_join(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return self._joined(plan, a, b, "merge")

    def _sort(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        keys = _split(_first(plan.params, "order_by", "sort_keys", "keys")) or list(plan.output_columns)
        if not keys:
            raise SyntaxProblem("SORT needs keys")
        found = []
        for k in keys:
            m = re.fullmatch(r"(.*?)(?:[:\s]+(ASC|DESC|ASCENDING|DESCENDING))?", k.strip(), re.I | re.S)
            n = _name(m[1])
            found.append((r.find(n.name, n.table), (m[2] or "").upper().startswith("DESC")))
        return R.sort(r, found)

    def _aggregate(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        keys = [r.find(n.name, n.table) for n in map(_name, _split(_first(plan.params, "group_by", "groupby", "group")))]
        texts = _split(_first(plan.params, "aggregates", "aggs", "agg"))
        texts += [plan.params[k] for k in sorted(plan.params) if k.startswith("agg.")]
        specs = [aggregate_spec(t) for t in texts]
        if not specs and not keys:
            raise SyntaxProblem("AGGREGATE needs aggregates or groups")
        spare = list(plan.output_columns[len(keys) :])
        named = [(alias or (spare[i] if i < len(spare) else N.text(call)), call) for i, (call, alias) in enumerate(specs)]
        over = Expressions(r)
        out = R.aggregate(r, keys, [(name, measure(call, over)) for name, call in named])
        if plan.params.get("having"):
            known = {call: f for (_, call), f in zip(named, out.fields[len(keys) :], strict=True)}
            out = R.filtered(out, Expressions(out, known).condition(parse_expression(plan.params["having"])))
        return out

    def _distinct(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        return R.distinct(r)

    def _limit(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        n = plan.params.get("limit")
        return R.limit(r, None if n in (None, "") else int(n), int(plan.params.get("offset") or 0))

    def _alias(self, plan: PlanNode, r: R.Relation) -> R.Relation:
        return R.alias(r, self._need(plan, "alias"))

    def _union(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return R.combine("UNION", a, b)

    def _intersect(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return R.combine("INTERSECT", a, b)

    def _difference(self, plan: PlanNode, a: R.Relation, b: R.Relation) -> R.Relation:
        return R.combine("EXCEPT", a, b)
