"""Row-level scope: predicates of the caller that are AND-ed onto the root, so they only narrow a query."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import date, datetime, timezone
from typing import Any

from ..sources.config import Config, is_identifier
from .ast import Compare, Logic, Query, Value
from .validate import Checker


class InvalidScope(ValueError):
    """A scope that cannot be applied. The message names keys, never values."""


def _payload(x: Any, key: str) -> tuple[str, Any]:
    """(kind, payload) of one scope value."""
    if isinstance(x, bool):
        return "boolean", x
    if isinstance(x, (int, float)):
        return "number", float(x)
    if isinstance(x, str):
        return "string", x
    if isinstance(x, datetime):
        at = x if x.tzinfo else x.replace(tzinfo=timezone.utc)
        return "date", at.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    if isinstance(x, date):
        return "date", x.isoformat()
    raise InvalidScope(f"scope {key!r} has a value of the unsupported type {type(x).__name__}")


def normalise(scope: Mapping[str, Any] | None, config: Config) -> list[Compare]:
    """The scope as predicates in order of their keys."""
    out: dict[str, Compare] = {}
    for raw in sorted(scope or {}, key=str):
        if not isinstance(raw, str) or not raw.strip():
            raise InvalidScope("a scope key is blank")
        key, x = raw.strip(), scope[raw]
        if not is_identifier(key):
            raise InvalidScope(f"scope key {key!r} is no identifier")
        if key in out:
            raise InvalidScope(f"scope key {key!r} is given twice")
        f = config.find(key)
        many = isinstance(x, (list, tuple, set, frozenset))
        if x is None or isinstance(x, (bytes, bytearray, Mapping)):
            raise InvalidScope(f"scope {key!r} has no usable value")
        items = [_payload(y, key) for y in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)] if many else [_payload(x, key)]
        if not items:
            raise InvalidScope(f"scope {key!r} has an empty list")
        if f:
            checker = Checker(config)
            for _, payload in items:
                checker.literal(key, key, f, f.item, payload)
            if many and len(items) > config.policy.ceiling("maxListLength"):
                checker.add("list_too_long", key, "the list is too long")
            if checker.problems:
                raise InvalidScope(f"scope {key!r}: {', '.join(sorted({p.code for p in checker.problems}))}")
        elif len({kind for kind, _ in items}) > 1:
            raise InvalidScope(f"scope {key!r} mixes types")
        array = f is not None and f.type == "array"
        if many:
            out[key] = Compare(key, "containsAny" if array else "in", Value("array", [p for _, p in items]), scoped=True)
        else:
            kind, payload = items[0]
            kind = f.item if f and f.item in ("enum", "date") else kind
            out[key] = Compare(key, "contains" if array else "equals", Value(kind, payload), scoped=True)
    return [out[k] for k in sorted(out)]


def apply_scope(q: Query, predicates: list[Compare]) -> Query:
    """A new query whose root is an AND of the predicates and the filter."""
    if not predicates:
        return q
    root = q.filter
    own = root.children if isinstance(root, Logic) and root.op == "AND" else () if root is None else (root,)
    if root is None and len(predicates) == 1:
        return replace(q, filter=predicates[0])
    return replace(q, filter=Logic("AND", (*predicates, *own)))
