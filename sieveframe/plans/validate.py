"""Checks of a query tree against its config. All problems are collected, each with a code and a path."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from typing import Any

from ..functions.literals import MAX_AMOUNT, UNITS, parse_date
from ..sources.config import Config, Field
from . import ast
from .regexguard import unsafe_part


@dataclass(frozen=True)
class Problem:
    code: str
    path: str
    message: str
    field: str = ""
    suggestions: tuple[str, ...] = ()

    def to_json(self) -> dict:
        out = {"code": self.code, "path": self.path, "message": self.message}
        return out | ({"field": self.field} if self.field else {}) | ({"suggestions": list(self.suggestions)} if self.suggestions else {})


class ValidationFailed(ValueError):
    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(f"{p.path}: {p.message}" for p in problems))
        self.problems = problems


#: The codes of problems.
CODES = (
    "malformed_ast", "entity_mismatch", "nesting_too_deep", "invalid_arity", "unknown_version", "filter_too_large",
    "list_too_long", "value_too_long", "duplicate_field", "invalid_relative_date", "regex_not_allowed",
    "regex_pattern_long", "regex_unsafe", "unknown_field", "field_not_queryable", "field_not_filterable",
    "field_not_sortable", "field_not_returnable", "field_not_searchable", "unknown_operator", "operator_not_allowed",
    "regex_denied", "kind_mismatch", "value_out_of_domain", "value_out_of_bounds", "value_required",
    "value_not_allowed", "invalid_sort_direction", "invalid_paging", "limit_too_large",
)


def fits(kind: str, x: Any) -> bool:
    """Whether a payload can be a literal of a field type; the kind tag has no say."""
    if kind in ("string", "enum"):
        return isinstance(x, str)
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    if kind == "boolean":
        return isinstance(x, bool)
    return kind == "date" and isinstance(x, str) and parse_date(x) is not None


class Checker:
    def __init__(self, config: Config):
        self.config, self.problems, self.nodes, self.suggested = config, [], 0, 0
        self.too_large = False

    def add(self, code: str, path: str, message: str, name: str = "", suggestions: tuple[str, ...] = ()) -> None:
        self.problems.append(Problem(code, path, message, name, suggestions))

    def unknown(self, path: str, name: str) -> None:
        self.add("unknown_field", path, f"unknown field {name!r}", name, self.suggest(name))

    def suggest(self, name: str) -> tuple[str, ...]:
        self.suggested += 1
        if self.suggested > self.config.policy.ceiling("maxSuggestCalls"):
            return ()
        low = name.lower()[:100]
        close = []
        for f in self.config.fields:
            if f.may_query:
                best = max(SequenceMatcher(None, low, alias.lower()).ratio() for alias in (f.name, *f.synonyms))
                close.append((-best, f.name))
        return tuple(n for score, n in sorted(close)[:3] if score <= -0.5)

    def query(self, q: ast.Query | None) -> list[Problem]:
        config = self.config
        if q is None:
            self.add("malformed_ast", "$", "there is no query")
            return self.problems
        if q.version not in ("", ast.VERSION):
            self.add("unknown_version", "version", f"unsupported version {q.version!r}")
        if q.entity != config.entity:
            self.add("entity_mismatch", "entity", f"the query is about {q.entity!r}, the config about {config.entity!r}")
        if q.filter is not None:
            self.node("filter", q.filter, 1)
        seen = set()
        for i, name in enumerate(q.select):
            path, f = f"select[{i}]", config.find(name)
            if name in seen:
                self.add("duplicate_field", path, f"{name!r} is selected twice", name)
            elif f is None:
                self.unknown(path, name)
            else:
                if not f.may_query:
                    self.add("field_not_queryable", path, f"{name!r} is excluded from queries", name)
                if not f.may_return:
                    self.add("field_not_returnable", path, f"{name!r} is never returned", name)
            seen.add(name)
        for i, s in enumerate(q.sort):
            path, f = f"sort[{i}]", config.find(s.field)
            if f is None:
                self.unknown(path, s.field)
            else:
                if not f.may_query:
                    self.add("field_not_queryable", path, f"{s.field!r} is excluded from queries", s.field)
                if not f.may_sort:
                    self.add("field_not_sortable", path, f"{s.field!r} cannot be sorted by", s.field)
            if s.dir.upper() not in ("", "ASC", "DESC"):
                self.add("invalid_sort_direction", path, f"direction {s.dir!r} is neither ASC nor DESC")
        for name in ("limit", "offset"):
            if (getattr(q, name) or 0) < 0:
                self.add("invalid_paging", name, f"{name} is negative")
        if config.defaults.maxLimit > 0 and (q.limit or 0) > config.defaults.maxLimit:
            self.add("limit_too_large", "limit", f"limit {q.limit} is above {config.defaults.maxLimit}")
        return self.problems

    def node(self, path: str, node: ast.Node, depth: int) -> None:
        """Size and depth are checked on the way down, so an oversized tree is not walked to its end."""
        if node is None:
            return self.add("malformed_ast", path, "the condition is missing")
        self.nodes += 1
        most, deepest = self.config.policy.ceiling("maxFilterNodes"), self.config.policy.maxNestingDepth
        if self.nodes > most:
            if not self.too_large:
                self.add("filter_too_large", path, f"the filter has more than {most} conditions")
            self.too_large = True
            return None
        if 0 < deepest < depth:
            return self.add("nesting_too_deep", path, f"depth {depth} is above {deepest}")
        if isinstance(node, ast.Compare):
            return self.compare(path, node)
        if not isinstance(node, ast.Logic):
            return self.add("malformed_ast", path, f"unknown type {node.type!r}")
        if node.op not in ast.CONNECTIVES:
            self.add("unknown_operator", path, f"unknown connective {node.op!r}")
        if not node.children:
            self.add("invalid_arity", path, f"{node.op} has no children")
        if node.op == "NOT" and len(node.children) != 1:
            self.add("invalid_arity", path, f"NOT takes one child, not {len(node.children)}")
        for i, child in enumerate(node.children):
            self.node(f"{path}.children[{i}]", child, depth + 1)
        return None

    def compare(self, path: str, c: ast.Compare) -> None:
        f, name = self.config.find(c.field), c.field
        if f is None:
            return self.unknown(path, name)
        if not f.may_query:
            return self.add("field_not_queryable", path, f"{name!r} is excluded from queries", name)
        if not f.may_filter:
            return self.add("field_not_filterable", path, f"{name!r} cannot be filtered by", name)
        if c.operator not in ast.OPERATORS:
            return self.add("unknown_operator", path, f"unknown operator {c.operator!r}", name)
        if c.operator not in f.allowed:
            return self.add("operator_not_allowed", path, f"{c.operator} is not allowed on {name!r} (allowed: {', '.join(f.allowed)})", name)
        if f.type in ("string", "enum") and c.operator in ast.TEXT_SEARCH and not f.may_search:
            self.add("field_not_searchable", path, f"{name!r} cannot be searched with {c.operator}", name)
        if c.operator == "regex":
            self.regex(path, c)
        if c.operator in ast.NULL_TESTS:
            if c.value is not None:
                self.add("value_not_allowed", path, f"{c.operator} takes no value", name)
        elif c.value is None:
            self.add("value_required", path, f"{c.operator} needs a value", name)
        else:
            self.literals(path, f, c)
        return None

    def regex(self, path: str, c: ast.Compare) -> None:
        policy, name = self.config.policy, c.field
        if name in policy.denyRegexOn:
            self.add("regex_denied", path, f"regex is denied on {name!r}", name)
        elif policy.allowRegexOn and name not in policy.allowRegexOn:
            self.add("regex_not_allowed", path, f"regex is not enabled on {name!r}", name)
        pattern = c.value.v if c.value else None
        if isinstance(pattern, str):
            most = policy.ceiling("maxRegexLength")
            if len(pattern.encode()) > most:
                self.add("regex_pattern_long", path, f"the pattern is longer than {most}", name)
            elif (part := unsafe_part(pattern)) is not None:
                self.add("regex_unsafe", path, f"{part!r} repeats a repetition without bound", name)

    def literals(self, path: str, f: Field, c: ast.Compare) -> None:
        kind, value = f.item, c.value
        if c.operator not in ast.LIST_OPERATORS:
            if value.relative:
                return self.relative(path, f, value)
            return self.literal(path, path, f, kind, value.v)
        items = value.v
        if value.relative or not isinstance(items, list):
            return self.add("kind_mismatch", path, f"{c.operator} needs a list", f.name)
        if c.operator == "between" and len(items) != 2:
            self.add("invalid_arity", path, f"between needs 2 values, not {len(items)}", f.name)
        if c.operator != "between" and not items:
            self.add("invalid_arity", path, f"{c.operator} needs at least one value", f.name)
        most = self.config.policy.ceiling("maxListLength")
        if len(items) > most:
            return self.add("list_too_long", path, f"{len(items)} values are more than {most}", f.name)
        for i, x in enumerate(items):
            self.literal(f"{path}.value[{i}]", path, f, kind, x)
        return None

    def literal(self, path: str, whole: str, f: Field, kind: str, x: Any) -> None:
        """Type, domain, bounds and length of one payload, scope literals included."""
        if not fits(kind, x):
            return self.add("kind_mismatch", path, f"the value is no {kind}", f.name)
        if kind == "enum" and x not in f.values:
            self.add("value_out_of_domain", path, f"the value is none of: {', '.join(f.values)}", f.name)
        if kind == "number" and f.validators:
            low, high = f.validators.min, f.validators.max
            if low is not None and x < low:
                self.add("value_out_of_bounds", whole, f"the value is below {low:g}", f.name)
            if high is not None and x > high:
                self.add("value_out_of_bounds", whole, f"the value is above {high:g}", f.name)
        most = self.config.policy.ceiling("maxValueLength")
        if isinstance(x, str) and len(x.encode("utf-8", "surrogatepass")) > most:
            self.add("value_too_long", path, f"the value is longer than {most}", f.name)
        return None

    def relative(self, path: str, f: Field, value: ast.Value) -> None:
        if f.item != "date":
            return self.add("kind_mismatch", path, f"a relative date is no {f.item}", f.name)
        if value.unit not in UNITS:
            self.add("invalid_relative_date", path, f"unit {value.unit!r} is none of: {', '.join(UNITS)}", f.name)
        if abs(value.amount) > MAX_AMOUNT:
            self.add("invalid_relative_date", path, f"amount {value.amount} is beyond {MAX_AMOUNT}", f.name)
        return None


def problems_of(q: ast.Query | None, config: Config) -> list[Problem]:
    return Checker(config).query(q)


def validate(q: ast.Query | None, config: Config) -> None:
    """Raise ValidationFailed with every problem there is."""
    if found := problems_of(q, config):
        raise ValidationFailed(found)
