"""Which physical tables a query reads: one, several, an alias, or those a routing rule names.

Only predicates that every result row has to satisfy may choose a table (see ast.conjuncts), and a field must have
exactly one of them. Unlike a literal comparison of the routing value, a rule is taken only where the query's own
operator implies it, so a routed query never loses rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from ..functions.literals import BadLiteral, parse_date, relative_date
from ..plans.ast import Compare, Query, conjuncts
from .config import Config, Routing, Source, When, is_index_name


class RoutingError(ValueError):
    """Routing that has no single answer, or names an impossible table."""


@dataclass(frozen=True)
class Resolved:
    names: tuple[str, ...]
    kind: str  # TABLE, MULTI, ALIAS or ROUTED


def _only(q: Query, name: str) -> Compare | None:
    found = [c for c in conjuncts(q.filter) if c.field == name]
    return found[0] if len(found) == 1 else None


def _instant(c: Compare, now: datetime) -> datetime | None:
    try:
        if c.value.relative:
            return relative_date(now, c.value.unit, c.value.amount)
    except BadLiteral:
        return None
    return parse_date(c.value.v) if isinstance(c.value.v, str) else None


def _implies(operator: str, value, when: str, limit) -> bool | None:
    """Whether ``x operator value`` makes ``x when limit`` certain."""
    if operator == "equals":
        return {
            "equals": value == limit,
            "notEquals": value != limit,
            "gt": value > limit if when == "gt" else False,
            "gte": value >= limit if when == "gte" else False,
            "lt": value < limit if when == "lt" else False,
            "lte": value <= limit if when == "lte" else False,
        }[when]
    up = operator in ("gt", "gte", "after")
    down = operator in ("lt", "lte", "before")
    strict = operator in ("gt", "lt")
    if up and when in ("gt", "gte"):
        return value > limit or value == limit and (strict or when == "gte")
    if down and when in ("lt", "lte"):
        return value < limit or value == limit and (strict or when == "lte")
    if when == "notEquals":
        return up and (value > limit or value == limit and strict) or down and (value < limit or value == limit and strict)
    return False


def _holds(q: Query, config: Config, when: When, now: datetime) -> bool:
    c, f = _only(q, when.field), config.find(when.field)
    if c is None or c.value is None or isinstance(c.value.v, list):
        return False
    if f.type == "number":
        return isinstance(c.value.v, float) and bool(_implies(c.operator, c.value.v, when.operator, float(when.value)))
    if f.type == "date":
        at = _instant(c, now)
        return at is not None and bool(_implies(c.operator, at, when.operator, parse_date(when.value)))
    if c.operator != "equals" or c.value.v is None:
        return False
    text = str(c.value.v).lower() if isinstance(c.value.v, bool) else c.value.v
    return text == when.value if when.operator == "equals" else text != when.value


def _named(routing: Routing, token_value: str) -> str:
    before, _, rest = routing.indexPattern.partition("{")
    name = before + token_value + rest.partition("}")[2]
    if not is_index_name(name):
        raise RoutingError(f"the value of {routing.field!r} makes no table name")
    return name


def _by_date(q: Query, routing: Routing, now: datetime) -> tuple[str, ...]:
    c = _only(q, routing.field)
    if c is None or c.value is None:
        return routing.default
    if c.operator == "between" and isinstance(c.value.v, list) and len(c.value.v) == 2:
        ends = [parse_date(x) if isinstance(x, str) else None for x in c.value.v]
    elif c.operator == "equals":
        ends = [_instant(c, now)] * 2
    else:
        return routing.default
    if None in ends:
        return routing.default
    return tuple(_named(routing, label) for label in partitions(min(ends), max(ends), routing.granularity))


def partitions(first: datetime, last: datetime, granularity: str) -> list[str]:
    """The labels of all years, months or days from ``first`` to ``last``, both included, however many there are."""
    if granularity == "YEAR":
        return [f"{year:04d}" for year in range(first.year, last.year + 1)]
    if granularity == "MONTH":
        months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
        return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in months]
    days = range(first.toordinal(), last.toordinal() + 1)
    return [date.fromordinal(d).isoformat() for d in days]


def route(q: Query, config: Config, routing: Routing, now: datetime) -> tuple[str, ...]:
    """The names for the effective (scoped) query."""
    if routing.strategy == "date":
        return _by_date(q, routing, now)
    if routing.strategy == "pattern":
        c = _only(q, routing.field)
        if c is None or c.operator != "equals" or c.value is None or not isinstance(c.value.v, (str, float)):
            return routing.default
        x = c.value.v
        return (_named(routing, f"{x:f}".rstrip("0").rstrip(".") if isinstance(x, float) else x),)
    if routing.strategy == "rules":
        hits = [r for r in routing.rules if _holds(q, config, r.when, now)]
        if not hits:
            return routing.default
        top = max(r.priority for r in hits)
        best = [r for r in hits if r.priority == top]
        if len(best) > 1:
            raise RoutingError(f"more than one rule matches at priority {top}")
        return best[0].indexes
    for branch in routing.branches:
        if branch.else_ or _holds(q, config, branch.if_, now):
            return branch.indexes
    return routing.default


def resolve_source(q: Query, config: Config, backend: str, now: datetime) -> Resolved:
    """The tables behind a backend; ``spark`` falls back to ``sql``, and every backend to the entity's name."""
    fallback = ("sql",) if backend in ("spark", "mysql") else ()
    source = next((config.backends[b] for b in (backend, *fallback) if b in config.backends), Source())
    if source.routing:
        return Resolved(route(q, config, source.routing, now), "ROUTED")
    if source.indexes:
        return Resolved(source.indexes, "MULTI")
    if source.alias:
        return Resolved((source.alias,), "ALIAS")
    return Resolved((source.single or config.entity,), "TABLE")
