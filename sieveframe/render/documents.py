"""Query documents for Mongo and for Elasticsearch or OpenSearch."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from ..operators.dataframe import projection
from ..operators.predicates import CompileError
from ..plans.ast import Compare, Logic, Node, Query
from ..plans.explain import ordered, page_limit, warnings
from ..sources.config import Config
from ..sources.routing import resolve_source
from .literals import blind, payload_of

_RANGE = {"gt": "gt", "lt": "lt", "gte": "gte", "lte": "lte", "after": "gte", "before": "lte"}


class Mongo:
    name = "mongo"

    def generate(self, q: Query, config: Config, now: datetime):
        from ..engine import Compiled

        path = lambda n: config.physical(n, self.name)
        source = resolve_source(q, config, self.name, now)
        shown = projection(q, config)
        doc: dict[str, Any] = {"collection": source.names[0], "filter": self._node(q.filter, config, now) if q.filter else {}}
        if shown:
            doc["projection"] = {path(n): 1 for n in shown}
        if q.sort:
            doc["sort"] = [[path(s.field), -1 if s.dir.upper() == "DESC" else 1] for s in q.sort]
        if limit := page_limit(q, config):
            doc["limit"] = limit
        if q.offset:
            doc["skip"] = q.offset
        return Compiled(self.name, doc=doc, warnings=tuple(warnings(q, config)), source=source)

    def _node(self, node: Node, config: Config, now: datetime) -> dict:
        if isinstance(node, Compare):
            return self._placed(node, config, self._compare(node, config, now))
        if not isinstance(node, Logic) or not node.children:
            raise CompileError("the filter has a node that is neither comparison nor connective")
        if node.op == "NOT":
            child = node.children[0]
            out = {"$nor": [self._node(child, config, now)]}
            f = config.find(child.field) if isinstance(child, Compare) else None
            if f and not f.elemMatch and child.operator not in ("isNull", "isNotNull"):
                # SQL drops a row whose column is null from a negation; so does this.
                return {"$and": [out, {config.physical(child.field, self.name): {"$exists": True, "$ne": None}}]}
            return out
        parts = [self._node(c, config, now) for c in ordered(node.children, config)]
        return (parts[0] if len(parts) == 1 else {"$or": parts}) if node.op == "OR" else merged(parts)

    def _placed(self, c: Compare, config: Config, test: Any) -> dict:
        f, path = config.find(c.field), config.physical(c.field, self.name)
        if isinstance(test, dict) and set(test) & {"$or", "$and"}:
            return test
        if f and f.elemMatch:
            return {f.elemMatch: {"$elemMatch": {path[len(f.elemMatch) + 1 :]: test}}}
        return {path: test}

    def _compare(self, c: Compare, config: Config, now: datetime) -> Any:
        op = c.operator
        if op == "isNull":
            return None
        if op == "isNotNull":
            return {"$ne": None}
        f, x, any_case = config.find(c.field), payload_of(c, config, now), blind(c, config)
        whole = lambda y: {"$regex": f"^{re.escape(y)}$", "$options": "i"}
        options = {"$options": "i"} if any_case or op == "contains" else {}
        path = config.physical(c.field, self.name)
        if any_case and op in ("in", "notIn"):
            tests = [{path: whole(y) if op == "in" else {"$not": whole(y)}} for y in x]
            return {"$or": tests} if op == "in" else {"$and": [*tests, {path: {"$exists": True, "$ne": None}}]}
        if op == "contains" and f and f.type == "array":
            return x
        table = {
            "equals": lambda: whole(x) if any_case else x,
            "notEquals": lambda: {"$not": whole(x), "$exists": True} if any_case else {"$ne": x, "$exists": True},
            "between": lambda: {"$gte": x[0], "$lte": x[1]},
            "in": lambda: {"$in": x},
            "notIn": lambda: {"$nin": [*x, None], "$exists": True},
            "containsAny": lambda: {"$in": x},
            "containsAll": lambda: {"$all": x},
            "contains": lambda: {"$regex": re.escape(x)} | options,
            "startsWith": lambda: {"$regex": "^" + re.escape(x)} | options,
            "endsWith": lambda: {"$regex": re.escape(x) + "$"} | options,
            "regex": lambda: {"$regex": x},
        }
        if op in _RANGE:
            return {"$" + _RANGE[op]: x}
        if op not in table:
            raise CompileError(f"{op} does not apply to {c.field!r}")
        return table[op]()


def merged(parts: list[dict]) -> dict:
    """The AND of filters: one document where no key meets another test, tests of one array's element together."""
    flat: list[dict] = []
    for p in parts:
        flat += p["$and"] if set(p) == {"$and"} else [p]
    elements: dict[str, list[dict]] = {}
    rest: list[dict] = []
    for p in flat:
        (key, test), *more = p.items()
        if not more and isinstance(test, dict) and set(test) == {"$elemMatch"}:
            elements.setdefault(key, []).append(test["$elemMatch"])
        else:
            rest.append(p)
    for key, tests in elements.items():
        rest.append({key: {"$elemMatch": tests[0] if len(tests) == 1 else merged(tests)}})
    out: dict = {}
    conflicts: list[dict] = []
    for p in rest:
        for key, test in p.items():
            old = out.get(key)
            if key not in out:
                out[key] = test
            elif _operators(old) and _operators(test) and not set(old) & set(test):
                out[key] = old | test
            else:
                conflicts.append({key: test})
    if not conflicts:
        return out
    # A conflicting test stands beside the others, whatever $and there already is.
    return {"$and": [{k: v} for k, v in out.items()] + conflicts}


def _operators(x: Any) -> bool:
    return isinstance(x, dict) and bool(x) and all(k.startswith("$") for k in x) and not set(x) & {"$regex", "$options"}


class Elastic:
    """Both search engines take one form."""

    def __init__(self, name: str):
        self.name = name

    def generate(self, q: Query, config: Config, now: datetime):
        from ..engine import Compiled

        source = resolve_source(q, config, self.name, now)
        shown = projection(q, config)
        body: dict[str, Any] = {"query": self._root(q.filter, config, now)}
        if shown:
            body["_source"] = [config.physical(n, self.name) for n in shown]
        if q.sort:
            body["sort"] = [{self._exact(s.field, config): {"order": s.dir.lower() or "asc"}} for s in q.sort]
        if limit := page_limit(q, config):
            body["size"] = limit
        if q.offset:
            body["from"] = q.offset
        kind = {"TABLE": "INDEX", "MULTI": "INDEXES", "ALIAS": "ALIAS", "ROUTED": "ROUTING"}[source.kind]
        doc = {"method": "GET", "path": f"/{','.join(source.names)}/_search", "indexes": list(source.names), "sourceType": kind, "body": body}
        return Compiled(self.name, doc=doc, warnings=tuple(warnings(q, config)), source=source)

    def _exact(self, name: str, config: Config) -> str:
        f = config.find(name)
        return (f.keywordMapping.get(self.name) if f else None) or config.physical(name, self.name)

    def _root(self, node: Node, config: Config, now: datetime) -> dict:
        return {"match_all": {}} if node is None else self._node(node, config, now)

    def _node(self, node: Node, config: Config, now: datetime) -> dict:
        if isinstance(node, Compare):
            return self._nested(config.find(node.field), self._compare(node, config, now))
        if not isinstance(node, Logic) or not node.children:
            raise CompileError("the filter has a node that is neither comparison nor connective")
        if node.op == "NOT":
            child = node.children[0]
            out: dict[str, Any] = {"must_not": [self._node(child, config, now)]}
            f = config.find(child.field) if isinstance(child, Compare) else None
            if f and not f.nestedPath and child.operator not in ("isNull", "isNotNull"):
                out["filter"] = [{"exists": {"field": self._exact(child.field, config)}}]
            return {"bool": out}
        if node.op == "OR":
            return {"bool": {"should": [self._node(c, config, now) for c in ordered(node.children, config)], "minimum_should_match": 1}}
        grouped: dict[str, list[dict]] = {}
        parts = []
        for c in ordered(node.children, config):
            f = config.find(c.field) if isinstance(c, Compare) else None
            if f and f.nestedPath:
                grouped.setdefault(f.nestedPath, []).append(self._compare(c, config, now))
            else:
                parts.append(self._node(c, config, now))
        for path, tests in grouped.items():
            parts.append({"nested": {"path": path, "query": tests[0] if len(tests) == 1 else {"bool": {"filter": tests}}}})
        return {"bool": {"filter": parts}}

    @staticmethod
    def _nested(f, test: dict) -> dict:
        return {"nested": {"path": f.nestedPath, "query": test}} if f and f.nestedPath else test

    def _compare(self, c: Compare, config: Config, now: datetime) -> dict:
        op, path, f = c.operator, self._exact(c.field, config), config.find(c.field)
        exists = {"exists": {"field": path}}
        if op == "isNull":
            return {"bool": {"must_not": [exists]}}
        if op == "isNotNull":
            return exists
        x = payload_of(c, config, now)
        stamp = lambda y: y.isoformat().replace("+00:00", "Z") if isinstance(y, datetime) else y
        x = [stamp(y) for y in x] if isinstance(x, list) else stamp(x)
        any_case = blind(c, config) or bool(f and f.caseInsensitive and op == "regex")

        def term(kind: str, y: Any) -> dict:
            return {kind: {path: {"value": y, "case_insensitive": True} if any_case else y if kind == "term" else {"value": y}}}

        one_of = {"bool": {"should": [term("term", y) for y in x], "minimum_should_match": 1}} if any_case and isinstance(x, list) else {"terms": {path: x}}
        if op in _RANGE:
            return {"range": {path: {_RANGE[op]: x}}}
        table = {
            "equals": lambda: term("term", x),
            "notEquals": lambda: {"bool": {"must_not": [term("term", x)], "filter": [exists]}},
            "between": lambda: {"range": {path: {"gte": x[0], "lte": x[1]}}},
            "in": lambda: one_of,
            "notIn": lambda: {"bool": {"must_not": [one_of], "filter": [exists]}},
            "containsAny": lambda: {"terms": {path: x}},
            "containsAll": lambda: {"bool": {"filter": [term("term", y) for y in x]}},
            "contains": lambda: term("term", x) if f and f.type == "array" else {"match": {config.physical(c.field, self.name): x}},
            "startsWith": lambda: term("prefix", x),
            "endsWith": lambda: term("wildcard", "*" + re.sub(r"([\\*?])", r"\\\1", x)),
            "regex": lambda: term("regexp", x),
        }
        if op not in table:
            raise CompileError(f"{op} does not apply to {c.field!r}")
        return table[op]()
