"""Literals on the driver: dates, relative dates, and the case rules of fields."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from typing import Any

#: Units of relative dates, and the largest amount.
UNITS = ("minute", "hour", "day", "week", "month", "year")
MAX_AMOUNT = 1_000_000

_DATE = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:\d{2})?)?", re.ASCII
)


class BadLiteral(ValueError):
    """A literal that does not fit its field."""


def parse_date(text: str) -> datetime | None:
    """A date, a date with time, or one with a zone, as naive UTC; None for anything else."""
    found = _DATE.fullmatch(text)
    if not found:
        return None
    year, month, day, hour, minute, second, fraction, zone = found.groups()
    try:
        at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0))
    except ValueError:
        return None
    at += timedelta(microseconds=int((fraction or "0").ljust(6, "0")[:6]))
    if zone and zone != "Z":
        hours, minutes = int(zone[1:3]), int(zone[4:])
        if hours > 23 or minutes > 59:
            return None
        try:
            at -= (1 if zone[0] == "+" else -1) * timedelta(hours=hours, minutes=minutes)
        except OverflowError:
            return None
    return at


def _month_later(at: datetime, months: int) -> datetime:
    """``months`` later; days beyond the end of that month run over into the next one."""
    first = at.year * 12 + at.month - 1 + months
    return at.replace(year=first // 12, month=first % 12 + 1, day=1) + timedelta(days=at.day - 1)


def relative_date(now: datetime, unit: str, amount: int) -> datetime:
    """``now`` (naive UTC) moved by ``amount`` units."""
    if unit not in UNITS:
        raise BadLiteral(f"unknown unit {unit!r} of a relative date")
    try:
        if unit in ("month", "year"):
            return _month_later(now, amount * (12 if unit == "year" else 1))
        return now + timedelta(**{f"{unit}s": amount})
    except (OverflowError, ValueError) as e:
        raise BadLiteral("a relative date out of range") from e


def utc(at: datetime | None) -> datetime:
    """The clock of a query as naive UTC; now, where none is given."""
    at = at or datetime.now(timezone.utc)
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def in_case(text: Any, case: str) -> Any:
    """A text literal in the case in which the field stores its values."""
    if not isinstance(text, str):
        return text
    return text.upper() if case == "upper" else text.lower() if case == "lower" else text
