"""SELECT statements for Postgres and MySQL."""

from __future__ import annotations

import json
import re
from datetime import datetime
from typing import Any

from ..operators.dataframe import projection
from ..operators.predicates import CompileError
from ..plans.ast import Compare, Logic, Node, Query
from ..plans.explain import ordered, page_limit, warnings
from ..sources.config import Config, is_identifier
from ..sources.routing import resolve_source
from .literals import blind, payload_of

#: Words that need quotes as names.
RESERVED = frozenset(
    "all analyse analyze and any array as asc between both by case cast check collate column constraint create cross "
    "current_date current_time current_timestamp current_user default deferrable delete desc distinct do else end "
    "except exists false fetch for foreign from full grant group having in index initially inner insert intersect "
    "into is join key leading left like limit lock natural not null offset on only or order outer primary read "
    "references rename right select session_user set show similar some table then to trailing true union unique "
    "update user using values when where window with write".split()
)
_SIGNS = {"equals": "=", "notEquals": "<>", "gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "after": ">=", "before": "<="}


class Postgres:
    name = "sql"
    quote = '"'

    def placeholder(self, number: int) -> str:
        return f"${number}"

    def paging(self, limit: int, offset: int) -> str:
        return (f" LIMIT {limit}" if limit else "") + (f" OFFSET {offset}" if offset else "")

    def regex(self, column: str, mark: str) -> str:
        return f"{column} ~ {mark}"

    def like(self, column: str, mark: str, any_case: bool) -> str:
        return f"{column} {'ILIKE' if any_case else 'LIKE'} {mark}"

    def array(self, column: str, op: str, items: list, bind) -> str:
        return f"{column} {'&&' if op == 'containsAny' else '@>'} ARRAY[{', '.join(bind(x) for x in items)}]"

    # --- one statement

    def identifier(self, path: str) -> str:
        if not is_identifier(path):
            raise CompileError(f"{path!r} is no identifier")
        mark = self.quote
        return ".".join(f"{mark}{x}{mark}" if x.lower() in RESERVED or not re.fullmatch(r"[A-Za-z_]\w*", x, re.ASCII) else x for x in path.split("."))

    def generate(self, q: Query, config: Config, now: datetime):
        from ..engine import Compiled

        args: list[Any] = []

        def bind(x: Any) -> str:
            args.append(x)
            return self.placeholder(len(args))

        def column(name: str) -> str:
            return self.identifier(config.physical(name, self.name))

        source = resolve_source(q, config, self.name, now)
        shown = projection(q, config)
        text = f"SELECT {', '.join(map(column, shown)) if shown else '*'} FROM {self.identifier(source.names[0])}"
        if q.filter is not None:
            text += " WHERE " + self._node(q.filter, config, now, bind, column)
        if q.sort:
            text += " ORDER BY " + ", ".join(f"{column(s.field)} {s.dir.upper() or 'ASC'}" for s in q.sort)
        text += self.paging(page_limit(q, config), q.offset or 0)
        return Compiled(self.name, text=text, args=tuple(args), warnings=tuple(warnings(q, config)), source=source)

    def _node(self, node: Node, config: Config, now: datetime, bind, column) -> str:
        if isinstance(node, Compare):
            return self._compare(node, config, now, bind, column)
        if not isinstance(node, Logic) or not node.children:
            raise CompileError("the filter has a node that is neither comparison nor connective")
        if node.op == "NOT":
            return f"NOT ({self._node(node.children[0], config, now, bind, column)})"
        parts = [self._node(c, config, now, bind, column) for c in ordered(node.children, config)]
        return parts[0] if len(parts) == 1 else f"({f' {node.op} '.join(parts)})"

    def _compare(self, c: Compare, config: Config, now: datetime, bind, column) -> str:
        f, op, name = config.find(c.field), c.operator, column(c.field)
        if op in ("isNull", "isNotNull"):
            return f"{name} IS {'NOT ' if op == 'isNotNull' else ''}NULL"
        x, any_case = payload_of(c, config, now), blind(c, config)
        low = lambda y: y.lower() if any_case and isinstance(y, str) else y
        side = f"LOWER({name})" if any_case else name
        array = f is not None and f.type == "array"
        if op in ("containsAny", "containsAll") or op == "contains" and array:
            return self.array(name, op, x if isinstance(x, list) else [x], bind)
        if op in ("contains", "startsWith", "endsWith"):
            pattern = ("" if op == "startsWith" else "%") + x + ("" if op == "endsWith" else "%")
            return self.like(name, bind(pattern), any_case)
        if op == "regex":
            return self.regex(name, bind(x))
        if op == "between":
            return f"{name} BETWEEN {bind(x[0])} AND {bind(x[1])}"
        if op in ("in", "notIn"):
            return f"{side} {'NOT ' if op == 'notIn' else ''}IN ({', '.join(bind(low(y)) for y in x)})"
        if op not in _SIGNS or array:
            raise CompileError(f"{op} does not apply to {c.field!r}")
        return f"{side} {_SIGNS[op]} {bind(low(x))}"


class MySql(Postgres):
    name = "mysql"
    quote = "`"

    def placeholder(self, number: int) -> str:
        return "?"

    def paging(self, limit: int, offset: int) -> str:
        return super().paging(limit or (18446744073709551615 if offset else 0), offset)

    def regex(self, column: str, mark: str) -> str:
        return f"{column} REGEXP {mark}"

    def like(self, column: str, mark: str, any_case: bool) -> str:
        return f"LOWER({column}) LIKE LOWER({mark})" if any_case else f"{column} LIKE {mark}"

    def array(self, column: str, op: str, items: list, bind) -> str:
        one = bind(json.dumps(items[0] if op == "contains" else items, default=str))
        return f"{'JSON_OVERLAPS' if op == 'containsAny' else 'JSON_CONTAINS'}({column}, {one})"
