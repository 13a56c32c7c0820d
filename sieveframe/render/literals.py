"""Literals of text backends: checked payloads with dates resolved and case rules applied."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from ..functions.literals import in_case, parse_date, relative_date
from ..operators.predicates import CompileError
from ..plans.ast import Compare
from ..plans.validate import fits
from ..sources.config import Config


def payload_of(c: Compare, config: Config, now: datetime) -> Any:
    """The literal of a comparison: a scalar or a list, dates as aware UTC datetimes, text in the field's case."""
    f, value = config.find(c.field), c.value
    if value is None:
        raise CompileError(f"{c.operator} on {c.field!r} has no value")
    if value.relative:
        return relative_date(now, value.unit, value.amount).replace(tzinfo=timezone.utc)
    kind = f.item if f else value.kind if value.kind != "array" else None

    def one(x: Any) -> Any:
        if f and not fits(kind, x):
            raise CompileError(f"the value on {c.field!r} is no {kind}")
        if kind == "date" and isinstance(x, str) and (at := parse_date(x)):
            return at.replace(tzinfo=timezone.utc)
        return in_case(x, f.valueCase) if f and c.operator != "regex" else x

    return [one(x) for x in value.v] if isinstance(value.v, list) else one(value.v)


def blind(c: Compare, config: Config) -> bool:
    """Whether the comparison ignores case."""
    f = config.find(c.field)
    return bool(f and f.caseInsensitive and c.operator in ("equals", "notEquals", "in", "notIn", "contains", "startsWith", "endsWith"))
