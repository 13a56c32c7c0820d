"""Predicates of a query tree as Catalyst expressions.

Top-level predicates follow SQL's three-valued logic: a negated comparison drops rows whose column is null. Tests of
array elements are two-valued: no array and no matching element both mean "no". Literals take the type of the column,
so filters reach the Parquet scan; text patterns are literal (contains, startswith), never LIKE.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.literals import BadLiteral, in_case, parse_date, relative_date
from ..plans.ast import Compare, Logic, Node, Value
from ..sources.config import Config, Field


class CompileError(ValueError):
    """A valid query that the data cannot answer: a missing column, a type that does not fit, a bad pattern."""


#: POSIX classes and their names in Java.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "space": "Space", "upper": "Upper", "lower": "Lower", "punct": "Punct"}

_SPARK_TYPES = {
    "string": (T.StringType, T.VarcharType, T.CharType),
    "enum": (T.StringType, T.VarcharType, T.CharType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "date": (T.TimestampNTZType, T.TimestampType, T.DateType),
}
_WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def java_pattern(pattern: str) -> str:
    return re.sub(r"\[:(\w+):\]", lambda m: f"\\p{{{POSIX[m[1]]}}}" if m[1] in POSIX else m[0], pattern)


def balanced(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    """Joined pair by pair: the depth grows with the logarithm of the number of parts."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def resolve(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path of exact names, through structs and arrays of structs; None if there is none."""
    kind: T.DataType = schema
    for name in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType):
            return None
        # Spark itself compares names without case: one more column of that spelling would be ambiguous.
        same = [f for f in kind.fields if f.name == name]
        if len(same) != 1 or sum(f.name.lower() == name.lower() for f in kind.fields) != 1:
            return None
        kind = same[0].dataType
    return kind


def quoted(path: str) -> Column:
    return F.col(".".join(f"`{x}`" for x in path.split(".")))


class Predicates:
    def __init__(self, config: Config, schema: T.StructType, now: datetime, check_pattern: Callable[[str], None] = lambda p: None, backend: str = "spark"):
        self.config, self.schema, self.now, self.backend, self.check_pattern = config, schema, now, backend, check_pattern

    # --- names and literals

    def path(self, name: str) -> str:
        path = self.config.physical(name, self.backend)
        if resolve(self.schema, path) is None:
            raise CompileError(f"field {name!r}: the table has no single column {path!r}")
        return path

    def _type(self, path: str, f: Field | None, name: str) -> T.DataType:
        kind = resolve(self.schema, path)
        if f is None:
            return kind
        if f.elemMatch and isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if f.type == "array":
            if not isinstance(kind, T.ArrayType):
                raise CompileError(f"field {name!r} is declared an array, the column is {kind.simpleString()}")
            kind = kind.elementType
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise CompileError(f"field {name!r} is declared {f.type}, the column is {kind.simpleString()}")
        if not isinstance(kind, _SPARK_TYPES[f.item]):
            raise CompileError(f"field {name!r} is declared {f.item}, the column is {kind.simpleString()}")
        return kind

    def literal(self, x: Any, kind: T.DataType, f: Field | None, name: str, fold: bool = True) -> Column:
        """One payload as a literal of the column's type."""
        if isinstance(kind, _SPARK_TYPES["string"]) and isinstance(x, str):
            return F.lit(in_case(x, f.valueCase) if f and fold else x)
        if isinstance(kind, T.BooleanType) and isinstance(x, bool):
            return F.lit(x)
        if isinstance(kind, _SPARK_TYPES["date"]):
            at = x if isinstance(x, datetime) else parse_date(x) if isinstance(x, str) else None
            if at is not None:
                return self._date(at, kind)
        if isinstance(kind, _SPARK_TYPES["number"]) and isinstance(x, (int, float)) and not isinstance(x, bool):
            return self._number(float(x), kind)
        raise CompileError(f"field {name!r}: the value does not fit the column's type {kind.simpleString()}")

    @staticmethod
    def _date(at: datetime, kind: T.DataType) -> Column:
        ntz = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        if isinstance(kind, T.TimestampType):
            return F.to_timestamp(F.lit(at.isoformat(sep=" ") + " UTC"), "yyyy-MM-dd HH:mm:ss[.SSSSSS] VV")
        # A date column is compared as the midnight it stands for.
        return ntz

    @staticmethod
    def _number(x: float, kind: T.DataType) -> Column:
        bits = _WHOLE.get(type(kind))
        if bits:
            whole = math.isfinite(x) and x == int(x) and -(1 << bits) <= int(x) < 1 << bits
            return F.lit(int(x)).cast(kind) if whole else F.lit(x)
        if isinstance(kind, T.DecimalType) and math.isfinite(x):
            return F.lit(Decimal(repr(x)))
        return F.lit(x).cast(kind) if isinstance(kind, T.FloatType) else F.lit(x)

    def payload(self, value: Value) -> Any:
        if not value.relative:
            return value.v
        try:
            return relative_date(self.now, value.unit, value.amount)
        except BadLiteral as e:
            raise CompileError(str(e)) from e

    # --- predicates

    def of(self, node: Node) -> Column:
        if isinstance(node, Compare):
            f = self.config.find(node.field)
            if f is not None and f.elemMatch:
                return self._elements(f.elemMatch, [node])
            path = self.path(node.field)
            return self.test(node, quoted(path), self._type(path, f, node.field))
        if not isinstance(node, Logic) or not node.children:
            raise CompileError("the filter has a node that is neither comparison nor connective")
        if node.op == "NOT":
            if len(node.children) != 1:
                raise CompileError("NOT takes one child")
            return ~self.of(node.children[0])
        if node.op == "AND":
            return balanced(self._and_parts(node), lambda a, b: a & b)
        if node.op == "OR":
            return balanced([self.of(c) for c in self._one_list(node.children)], lambda a, b: a | b)
        raise CompileError(f"unknown connective {node.op!r}")

    def _one_list(self, children: tuple[Node, ...]) -> list[Node]:
        """Alternatives with equals on one field become one membership test."""
        plain: dict[str, list] = {}
        for c in children:
            if isinstance(c, Compare) and c.operator == "equals" and c.value and not c.value.relative:
                f = self.config.find(c.field)
                if f and not f.elemMatch and f.type != "array":
                    plain.setdefault(c.field, []).append(c)
        merged = {n: cs for n, cs in plain.items() if len(cs) > 1}
        rest = [c for c in children if not (isinstance(c, Compare) and c in merged.get(c.field, ()))]
        return rest + [Compare(n, "in", Value("array", [c.value.v for c in cs])) for n, cs in merged.items()]

    def _and_parts(self, node: Logic) -> list[Column]:
        """Predicates on elements of one array hold for one and the same element; an AND of nothing else joins them."""
        parts, grouped = [], {}
        for child in node.children:
            inner = self._element_only(child)
            if inner:
                grouped.setdefault(inner[0], []).extend(inner[1])
            else:
                parts.append(self.of(child))
        return parts + [self._elements(path, found) for path, found in grouped.items()]

    def _element_only(self, node: Node) -> tuple[str, list[Compare]] | None:
        if isinstance(node, Compare):
            f = self.config.find(node.field)
            return (f.elemMatch, [node]) if f and f.elemMatch else None
        if isinstance(node, Logic) and node.op == "AND" and node.children:
            inner = [self._element_only(c) for c in node.children]
            if all(inner) and len({x[0] for x in inner}) == 1:
                return inner[0][0], [c for x in inner for c in x[1]]
        return None

    def _elements(self, path: str, found: list[Compare]) -> Column:
        if not isinstance(resolve(self.schema, path), T.ArrayType):
            raise CompileError(f"{path!r} is no array")
        tests = []
        for c in found:
            whole = self.path(c.field)
            if not whole.startswith(path + "."):
                raise CompileError(f"field {c.field!r} lies outside {path!r}")
            kind = self._inner_type(path, whole, c.field)
            tests.append((c, whole[len(path) + 1 :].split("."), kind))

        def one(x: Column) -> Column:
            built = []
            for c, names, kind in tests:
                inner = x
                for n in names:
                    inner = inner.getField(n)
                built.append(self.test(c, inner, kind))
            return balanced(built, lambda a, b: a & b)

        return F.coalesce(F.exists(quoted(path), one), F.lit(False))

    def _inner_type(self, path: str, whole: str, name: str) -> T.DataType:
        kind = resolve(self.schema, whole)
        f = self.config.find(name)
        if isinstance(kind, T.ArrayType) and f.type != "array" or not isinstance(kind, T.ArrayType) and f.type == "array":
            raise CompileError(f"field {name!r} is declared {f.type}, the column is {kind.simpleString()}")
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, _SPARK_TYPES[f.item]):
            raise CompileError(f"field {name!r} is declared {f.item}, the column is {inner.simpleString()}")
        return inner

    def test(self, c: Compare, column: Column, kind: T.DataType) -> Column:
        """One comparison on a column, or on a field of an array's element."""
        f, op = self.config.find(c.field), c.operator
        if op == "isNull":
            return column.isNull()
        if op == "isNotNull":
            return column.isNotNull()
        if c.value is None:
            raise CompileError(f"{op} on {c.field!r} has no value")
        x = self.payload(c.value)
        if isinstance(kind, T.DateType) and op not in ("isNull", "isNotNull"):
            column = column.cast("timestamp_ntz")
        array = f is not None and f.type == "array" or f is None and isinstance(kind, T.ArrayType)
        if array and isinstance(kind, T.ArrayType):
            kind = kind.elementType
        blind = f is not None and f.caseInsensitive and op in ("equals", "notEquals", "in", "notIn", "contains", "startsWith", "endsWith")
        lit = lambda y, fold=True: self.literal(y.lower() if blind and isinstance(y, str) else y, kind, f, c.field, fold)
        if op in ("between", "in", "notIn", "containsAny", "containsAll"):
            if not isinstance(x, list) or not x or op == "between" and len(x) != 2:
                raise CompileError(f"{op} on {c.field!r} needs a list")
        if array:
            return self._array_test(c, column, op, x, lit)
        side = F.lower(column) if blind else column
        if op in ("contains", "startsWith", "endsWith", "regex") and not isinstance(kind, _SPARK_TYPES["string"]):
            raise CompileError(f"{op} needs text, {c.field!r} is {kind.simpleString()}")
        simple = {
            "equals": lambda: side == lit(x),
            "notEquals": lambda: side != lit(x),
            "gt": lambda: column > lit(x),
            "lt": lambda: column < lit(x),
            "gte": lambda: column >= lit(x),
            "lte": lambda: column <= lit(x),
            "after": lambda: column >= lit(x),
            "before": lambda: column <= lit(x),
            "between": lambda: (column >= lit(x[0])) & (column <= lit(x[1])),
            "in": lambda: side.isin([lit(y) for y in x]),
            "notIn": lambda: ~side.isin([lit(y) for y in x]),
            "contains": lambda: side.contains(lit(x)),
            "startsWith": lambda: side.startswith(lit(x)),
            "endsWith": lambda: side.endswith(lit(x)),
            "regex": lambda: self._regex(column, x, c.field),
        }
        if op not in simple:
            raise CompileError(f"{op} does not apply to {c.field!r}")
        return simple[op]()

    def _array_test(self, c: Compare, column: Column, op: str, x: Any, lit: Callable) -> Column:
        holds = lambda y: F.exists(column, lambda e: e.eqNullSafe(lit(y)))
        if op == "contains":
            return holds(x)
        if op == "containsAny":
            return balanced([holds(y) for y in x], lambda a, b: a | b)
        if op == "containsAll":
            return balanced([holds(y) for y in x], lambda a, b: a & b)
        raise CompileError(f"{op} does not apply to the array {c.field!r}")

    def _regex(self, column: Column, pattern: Any, name: str) -> Column:
        if not isinstance(pattern, str):
            raise CompileError(f"the pattern on {name!r} is no text")
        pattern = java_pattern(pattern)
        self.check_pattern(pattern)
        return column.rlike(pattern)
