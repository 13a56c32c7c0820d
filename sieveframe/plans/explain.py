"""A readback of a query in plain English, and advice about predicates on unindexed fields."""

from __future__ import annotations

from ..sources.config import Config
from .ast import Compare, Logic, Node, Query, Value, comparisons

_PHRASES = {
    "equals": "is {}", "notEquals": "is not {}", "gt": "is greater than {}", "lt": "is less than {}",
    "gte": "is at least {}", "lte": "is at most {}", "between": "is between {}", "in": "is one of {}",
    "notIn": "is none of {}", "contains": "contains {}", "containsAny": "contains any of {}",
    "containsAll": "contains all of {}", "startsWith": "starts with {}", "endsWith": "ends with {}",
    "regex": "matches the pattern {}", "before": "is on or before {}", "after": "is on or after {}",
    "isNull": "is missing", "isNotNull": "is present",
}


def _plain(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return f'"{x}"' if isinstance(x, str) else str(x)


def describe_value(value: Value, operator: str = "") -> str:
    if value.relative:
        n, unit = abs(value.amount), value.unit + ("" if abs(value.amount) == 1 else "s")
        return "now" if not n else f"{n} {unit} {'ago' if value.amount < 0 else 'from now'}"
    if isinstance(value.v, list):
        return (" and " if operator == "between" else ", ").join(_plain(x) for x in value.v)
    return _plain(value.v)


def describe(node: Node) -> str:
    if isinstance(node, Compare):
        phrase = _PHRASES.get(node.operator, node.operator + " {}")
        return f"{node.field} " + phrase.format(describe_value(node.value, node.operator) if node.value else "")
    if isinstance(node, Logic):
        if node.op == "NOT":
            return f"not ({describe(node.children[0])})"
        parts = [describe(c) for c in node.children]
        return parts[0] if len(parts) == 1 else "(" + f" {node.op.lower()} ".join(parts) + ")"
    return "an unknown condition"


def _same_element(node: Node, config: Config) -> list[str]:
    """Arrays of which one element has to satisfy several predicates."""
    out = []
    if isinstance(node, Logic):
        if node.op == "AND":
            paths = [config.find(c.field).elemMatch for c in node.children if isinstance(c, Compare) and config.find(c.field)]
            out += [p for p in dict.fromkeys(paths) if p and paths.count(p) > 1]
        for child in node.children:
            out += _same_element(child, config)
    return list(dict.fromkeys(out))


def explain(q: Query, config: Config) -> str:
    """What the (scoped) query returns."""
    lines = [f"Return {', '.join(q.select)} of {q.entity}" if q.select else f"Return {q.entity}"]
    scoped = [c for c in comparisons(q.filter) if c.scoped]
    root = q.filter
    own = [c for c in root.children if not (isinstance(c, Compare) and c.scoped)] if scoped and isinstance(root, Logic) else [] if scoped else [root] if root else []
    if own:
        lines.append("where " + " and ".join(describe(c) for c in own))
    if scoped:
        lines.append("Always scoped to: " + " and ".join(describe(c) for c in scoped))
    for path in _same_element(root, config):
        lines.append(f"The conditions on {path} hold for one and the same element")
    if q.sort:
        lines.append("Sorted by " + ", ".join(f"{s.field} {'descending' if s.dir.upper() == 'DESC' else 'ascending'}" for s in q.sort))
    limit = page_limit(q, config)
    if limit:
        lines.append(f"At most {limit} rows")
    if q.offset:
        lines.append(f"The first {q.offset} are skipped")
    return ". ".join(lines) + "."


def page_limit(q: Query, config: Config) -> int:
    """The limit in force; 0 is none. An explicit 0 asks for no limit and gets the ceiling where there is one."""
    if q.limit is None:
        return max(config.defaults.limit, 0)
    return q.limit if q.limit > 0 else max(config.defaults.maxLimit, 0)


def warnings(q: Query, config: Config) -> list[str]:
    """One line for each declared field that is filtered by and not indexed."""
    names = dict.fromkeys(c.field for c in comparisons(q.filter))
    return [f"field {n!r} is not indexed; filtering by it may scan all rows" for n in names if (f := config.find(n)) and not f.indexed]


def ordered(children: tuple[Node, ...], config: Config) -> list[Node]:
    """Siblings of an AND or OR for the text forms: scope first, then indexed fields, then by priority."""

    def rank(node: Node) -> tuple:
        if not isinstance(node, Compare):
            return (2, 1, 0)
        f = config.find(node.field)
        return (0 if node.scoped else 1, 0 if f and f.indexed else 1, -(f.priority if f else 0))

    return sorted(children, key=rank)
