"""The query tree: plain data, its JSON form, and walks over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

VERSION = "1.0"

#: The comparison operators and connectives of the tree.
OPERATORS = (
    "equals", "notEquals", "gt", "lt", "gte", "lte", "between", "in", "notIn", "contains", "containsAny",
    "containsAll", "startsWith", "endsWith", "regex", "before", "after", "isNull", "isNotNull",
)
CONNECTIVES = ("AND", "OR", "NOT")
NULL_TESTS = frozenset({"isNull", "isNotNull"})
LIST_OPERATORS = frozenset({"between", "in", "notIn", "containsAny", "containsAll"})
TEXT_SEARCH = frozenset({"contains", "startsWith", "endsWith", "regex"})
#: The kinds of literals.
KINDS = ("string", "number", "boolean", "enum", "array", "date", "relative_date")


class MalformedTree(ValueError):
    """JSON that is no query tree."""


@dataclass(frozen=True)
class Value:
    kind: str
    v: Any = None
    unit: str = ""
    amount: int = 0

    @property
    def relative(self) -> bool:
        return self.kind == "relative_date"

    def to_json(self) -> dict:
        return {"kind": self.kind, "unit": self.unit, "amount": self.amount} if self.relative else {"kind": self.kind, "v": self.v}


@dataclass(frozen=True)
class Compare:
    field: str
    operator: str
    value: Value | None = None
    #: Set for predicates that the caller's scope added; no part of the JSON form.
    scoped: bool = False

    def to_json(self) -> dict:
        out = {"type": "comparison", "field": self.field, "operator": self.operator}
        return out | ({"value": self.value.to_json()} if self.value else {})


@dataclass(frozen=True)
class Logic:
    op: str
    children: tuple["Node", ...] = ()

    def to_json(self) -> dict:
        return {"type": "logical", "op": self.op, "children": [c.to_json() if c else None for c in self.children]}


@dataclass(frozen=True)
class Unknown:
    """A node whose type is neither; kept so that validation can report it in its place."""

    type: str

    def to_json(self) -> dict:
        return {"type": self.type}


Node = Compare | Logic | Unknown | None


@dataclass(frozen=True)
class Sort:
    field: str
    dir: str = ""

    def to_json(self) -> dict:
        return {"field": self.field, "dir": self.dir}


@dataclass(frozen=True)
class Query:
    entity: str = ""
    version: str = VERSION
    select: tuple[str, ...] = ()
    filter: Node = None
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int | None = None

    def to_json(self) -> dict:
        out: dict[str, Any] = {"version": self.version, "entity": self.entity}
        if self.select:
            out["select"] = list(self.select)
        if self.filter is not None:
            out["filter"] = self.filter.to_json()
        if self.sort:
            out["sort"] = [s.to_json() for s in self.sort]
        for name in ("limit", "offset"):
            if getattr(self, name) is not None:
                out[name] = getattr(self, name)
        return out


def _as(kind: type | tuple, x: Any, what: str, default: Any = None) -> Any:
    if x is None:
        return default
    if not isinstance(x, kind) or (isinstance(x, bool) and kind is not bool):
        raise MalformedTree(f"{what} has the wrong type")
    return x


def _whole(x: Any, what: str) -> int | None:
    x = _as((int, float), x, what)
    if x is not None and x != int(x):
        raise MalformedTree(f"{what} is no whole number")
    return None if x is None else int(x)


def _plain(x: Any) -> Any:
    """Numbers as floats, as JSON has no other kind; containers element by element."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {k: _plain(y) for k, y in x.items()}
    raise MalformedTree(f"a literal of type {type(x).__name__}")


def value_from(raw: Any) -> Value | None:
    raw = _as(dict, raw, "value")
    if raw is None:
        return None
    return Value(
        _as(str, raw.get("kind"), "value.kind", ""),
        _plain(raw.get("v")),
        _as(str, raw.get("unit"), "value.unit", ""),
        _whole(raw.get("amount"), "value.amount") or 0,
    )


def node_from(raw: Any, depth: int = 0) -> Node:
    raw = _as(dict, raw, "condition")
    if raw is None:
        return None
    if depth > 200:
        raise MalformedTree("the filter is nested too deeply")
    kind = _as(str, raw.get("type"), "condition.type", "")
    if kind == "logical":
        children = _as(list, raw.get("children"), "children", [])
        return Logic(_as(str, raw.get("op"), "op", ""), tuple(node_from(c, depth + 1) for c in children))
    if kind == "comparison":
        return Compare(_as(str, raw.get("field"), "field", ""), _as(str, raw.get("operator"), "operator", ""), value_from(raw.get("value")))
    return Unknown(kind)


def query_from(raw: Any) -> Query:
    """The tree of a decoded JSON object. Unknown keys are ignored; wrong types raise MalformedTree."""
    raw = _as(dict, raw, "query", {})
    sort = [_as(dict, s, "sort", {}) for s in _as(list, raw.get("sort"), "sort", [])]
    return Query(
        _as(str, raw.get("entity"), "entity", ""),
        _as(str, raw.get("version"), "version", ""),
        tuple(_as(str, s, "select", "") for s in _as(list, raw.get("select"), "select", [])),
        node_from(raw.get("filter")),
        tuple(Sort(_as(str, s.get("field"), "sort.field", ""), _as(str, s.get("dir"), "sort.dir", "")) for s in sort),
        _whole(raw.get("limit"), "limit"),
        _whole(raw.get("offset"), "offset"),
    )


def comparisons(node: Node) -> Iterator[Compare]:
    if isinstance(node, Compare):
        yield node
    elif isinstance(node, Logic):
        for child in node.children:
            yield from comparisons(child)


def conjuncts(node: Node) -> Iterator[Compare]:
    """The comparisons that every row of the result has to satisfy: those below the root through AND only."""
    if isinstance(node, Compare):
        yield node
    elif isinstance(node, Logic) and node.op == "AND":
        for child in node.children:
            yield from conjuncts(child)


# Short forms for building trees in Python.
def literal(x: Any) -> Value:
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return Value("boolean", x)
    if isinstance(x, (int, float)):
        return Value("number", float(x))
    if isinstance(x, (list, tuple)):
        return Value("array", _plain(list(x)))
    return Value("string", x)


def where(name: str, operator: str, x: Any = None) -> Compare:
    return Compare(name, operator, None if operator in NULL_TESTS and x is None else literal(x))


def ago(amount: int, unit: str) -> Value:
    return Value("relative_date", unit=unit, amount=amount)


def all_of(*nodes: Node) -> Logic:
    return Logic("AND", nodes)


def any_of(*nodes: Node) -> Logic:
    return Logic("OR", nodes)


def negate(node: Node) -> Logic:
    return Logic("NOT", (node,))


def rewrite(node: Node, change: Callable[[Compare], Node]) -> Node:
    if isinstance(node, Logic):
        return replace(node, children=tuple(rewrite(c, change) for c in node.children))
    return change(node) if isinstance(node, Compare) else node
