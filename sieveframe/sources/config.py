"""The strict, declared description of an entity: fields, sources, limits and policy."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.literals import parse_date
from ..plans.ast import OPERATORS

#: Field types and the operators a field allows unless it lists its own.
_EQUALITY = ("equals", "notEquals")
_NULLS = ("isNull", "isNotNull")
DEFAULT_OPERATORS = {
    "string": (*_EQUALITY, "contains", "startsWith", "endsWith", "in", "notIn", *_NULLS),
    "number": (*_EQUALITY, "gt", "lt", "gte", "lte", "between", "in", "notIn", *_NULLS),
    "boolean": (*_EQUALITY, *_NULLS),
    "enum": (*_EQUALITY, "in", "notIn", *_NULLS),
    "date": ("before", "after", "between", "equals", *_NULLS),
    "array": ("contains", "containsAny", "containsAll", *_NULLS),
}
#: Beginnings of known API keys; the built-in ceilings of the policy; tokens of date partitions.
KEY_PREFIXES = ("AIza", "sk-", "sk-ant-", "gsk_", "ghp_", "xox")
CEILINGS = {"maxFilterNodes": 500, "maxListLength": 500, "maxValueLength": 4096, "maxRegexLength": 256, "maxSuggestCalls": 10}
DATE_TOKENS = {"YEAR": "yyyy", "MONTH": "yyyy-MM", "DAY": "yyyy-MM-dd"}
ROUTED = ("elasticsearch", "opensearch", "spark")

_SEGMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PATH_SEGMENT = re.compile(r"[A-Za-z0-9_\-]+")
_INDEX = re.compile(r"[a-z0-9.][a-z0-9\-_.+]{0,254}")


class ConfigError(ValueError):
    """A config that cannot be used; the message says where and why, and never repeats a key."""


def is_identifier(path: str) -> bool:
    return bool(path) and all(_SEGMENT.fullmatch(x) for x in path.split("."))


def is_dot_path(path: str) -> bool:
    return bool(path) and all(_PATH_SEGMENT.fullmatch(x) for x in path.split("."))


def is_index_name(name: str) -> bool:
    return bool(_INDEX.fullmatch(name)) and name not in (".", "..")


@dataclass(frozen=True)
class When:
    field: str = ""
    operator: str = ""
    value: str = ""


@dataclass(frozen=True)
class Rule:
    when: When = When()
    indexes: tuple[str, ...] = ()
    priority: int = 0


@dataclass(frozen=True)
class Branch:
    if_: When | None = None
    else_: bool = False
    indexes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Routing:
    strategy: str = ""
    field: str = ""
    indexPattern: str = ""
    granularity: str = ""
    rules: tuple[Rule, ...] = ()
    branches: tuple[Branch, ...] = ()
    default: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    table: str = ""
    collection: str = ""
    index: str = ""
    name: str = ""
    indexes: tuple[str, ...] = ()
    alias: str = ""
    routing: Routing | None = None

    @property
    def single(self) -> str:
        return self.table or self.collection or self.index or self.name


@dataclass(frozen=True)
class Bounds:
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Field:
    name: str = ""
    type: str = ""
    values: tuple[str, ...] = ()
    itemType: str = ""
    operators: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    mapping: dict[str, str] = field(default_factory=dict)
    elemMatch: str = ""
    valueCase: str = ""
    caseInsensitive: bool = False
    keywordMapping: dict[str, str] = field(default_factory=dict)
    nestedPath: str = ""
    routingField: bool = False
    queryable: bool | None = None
    filterable: bool | None = None
    searchable: bool | None = None
    sortable: bool | None = None
    returnable: bool | None = None
    indexed: bool = False
    priority: int = 0
    validators: Bounds | None = None

    @property
    def item(self) -> str:
        """The type of a literal that is compared with the field or one of its elements."""
        return (self.itemType or "string") if self.type == "array" else self.type

    @property
    def allowed(self) -> tuple[str, ...]:
        return self.operators or DEFAULT_OPERATORS[self.type]

    @property
    def may_query(self) -> bool:
        return self.queryable is not False

    @property
    def may_filter(self) -> bool:
        return self.filterable is not False

    @property
    def may_search(self) -> bool:
        return self.type == "string" if self.searchable is None else self.searchable

    @property
    def may_sort(self) -> bool:
        return self.type != "array" if self.sortable is None else self.sortable

    @property
    def may_return(self) -> bool:
        return self.returnable is not False

    @property
    def textual(self) -> bool:
        return self.item in ("string", "enum")


@dataclass(frozen=True)
class Model:
    provider: str = ""
    baseURL: str = ""
    model: str = ""
    apiKeyEnv: str = ""
    temperature: float = 0.0
    maxTokens: int = 0
    protocol: str = ""
    timeoutSeconds: int = 0
    maxRetries: int | None = None
    retryBackoffMs: int = 0
    jsonMode: bool | None = None


@dataclass(frozen=True)
class Defaults:
    limit: int = 0
    maxLimit: int = 0


@dataclass(frozen=True)
class Policy:
    maxNestingDepth: int = 0
    denyRegexOn: tuple[str, ...] = ()
    allowRegexOn: tuple[str, ...] = ()
    maxFilterNodes: int = 0
    maxListLength: int = 0
    maxValueLength: int = 0
    maxRegexLength: int = 0
    maxSuggestCalls: int = 0

    def ceiling(self, name: str) -> float:
        """The bound in force: as configured, built in where it is 0, none where it is negative."""
        own = getattr(self, name)
        return float("inf") if own < 0 else own or CEILINGS[name]


@dataclass(frozen=True)
class Config:
    entity: str = ""
    version: int = 0
    model: Model = Model()
    models: tuple[Model, ...] = ()
    backends: dict[str, Source] = field(default_factory=dict)
    fields: tuple[Field, ...] = ()
    defaults: Defaults = Defaults()
    policy: Policy = Policy()

    def find(self, name: str) -> Field | None:
        return self._by_name.get(name)

    @property
    def _by_name(self) -> dict[str, Field]:
        cached = self.__dict__.get("_names")
        if cached is None:
            cached = {f.name: f for f in self.fields}
            object.__setattr__(self, "_names", cached)
        return cached

    def synonym(self, text: str) -> Field | None:
        """The field with this name or synonym, without regard to case; of several, the last declared."""
        wanted, out = text.lower(), None
        for f in self.fields:
            if wanted in (f.name.lower(), *(s.lower() for s in f.synonyms)):
                out = f
        return out

    def physical(self, name: str, backend: str) -> str:
        """The column behind a logical field."""
        f = self.find(name)
        mapping = f.mapping if f else {}
        fallback = ("sql",) if backend in ("mysql", "spark") else ()
        return next((mapping[b] for b in (backend, *fallback) if mapping.get(b)), name)


# --- strict decoding ---------------------------------------------------------------------------------------------

_TEXT, _WHOLE, _NUMBER, _FLAG = str, int, (int, float), bool
_TEXTS = ("list", str)


def _shape(cls: type, **nested: Any) -> dict[str, Any]:
    kinds = {"str": _TEXT, "int": _WHOLE, "float": _NUMBER, "bool": _FLAG, "tuple[str, ...]": _TEXTS, "dict[str, str]": ("map", str)}
    out = {}
    for name, f in cls.__dataclass_fields__.items():
        out[name] = nested.get(name) or kinds[f.type.removesuffix(" | None")]
    return out


def _decode(raw: Any, cls: type, where: str, shape: dict[str, Any], rename: dict[str, str] | None = None) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be an object")
    rename = rename or {}
    got = {}
    for key, x in raw.items():
        name = rename.get(key, key)
        if name not in shape or (key in rename.values() and key not in rename):
            raise ConfigError(f"{where} has the unknown key {key!r}")
        if x is not None:
            got[name] = _typed(x, shape[name], f"{where}.{key}")
    return cls(**got)


def _typed(x: Any, kind: Any, where: str) -> Any:
    if callable(kind) and not isinstance(kind, type):
        return kind(x, where)
    if isinstance(kind, tuple) and kind[0] == "list":
        if not isinstance(x, list):
            raise ConfigError(f"{where} must be a list")
        return tuple(_typed(y, kind[1], f"{where}[{i}]") for i, y in enumerate(x))
    if isinstance(kind, tuple) and kind[0] == "map":
        if not isinstance(x, dict):
            raise ConfigError(f"{where} must be an object")
        return {k: _typed(y, kind[1], f"{where}.{k}") for k, y in x.items()}
    if not isinstance(x, kind) or (isinstance(x, bool) and kind is not bool):
        raise ConfigError(f"{where} has the wrong type")
    return float(x) if kind is _NUMBER else x


def _when(x: Any, where: str) -> When:
    return _decode(x, When, where, _shape(When))


def _rule(x: Any, where: str) -> Rule:
    return _decode(x, Rule, where, _shape(Rule, when=_when))


def _branch(x: Any, where: str) -> Branch:
    return _decode(x, Branch, where, {"if_": _when, "else_": _FLAG, "indexes": _TEXTS}, {"if": "if_", "else": "else_"})


def _routing(x: Any, where: str) -> Routing:
    return _decode(x, Routing, where, _shape(Routing, rules=("list", _rule), branches=("list", _branch)))


def _source(x: Any, where: str) -> Source:
    return _decode(x, Source, where, _shape(Source, routing=_routing))


def _bounds(x: Any, where: str) -> Bounds:
    return _decode(x, Bounds, where, _shape(Bounds))


def _field(x: Any, where: str) -> Field:
    return _decode(x, Field, where, _shape(Field, validators=_bounds))


def _model(x: Any, where: str) -> Model:
    return _decode(x, Model, where, _shape(Model))


def load_config(raw: str | bytes | dict) -> Config:
    """A checked config from JSON text or a decoded object."""
    if not isinstance(raw, dict):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ConfigError("the config is no JSON") from e
    shape = {
        "entity": _TEXT,
        "version": _WHOLE,
        "model": _model,
        "models": ("list", _model),
        "backends": ("map", _source),
        "fields": ("list", _field),
        "defaults": lambda x, w: _decode(x, Defaults, w, _shape(Defaults)),
        "policy": lambda x, w: _decode(x, Policy, w, _shape(Policy)),
    }
    config = _decode(raw, Config, "config", shape)
    check(config)
    return config


# --- rules -------------------------------------------------------------------------------------------------------


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def check(config: Config) -> None:
    """Raise ConfigError unless every rule for configs holds."""
    _need(config.entity.strip(), "config.entity is blank")
    _need(config.fields, "config.fields is empty")
    for where, model in [("model", config.model), *((f"models[{i}]", m) for i, m in enumerate(config.models))]:
        _check_model(model, where)
    for backend, source in config.backends.items():
        if backend in ("sql", "mysql"):
            _need(not source.table or is_identifier(source.table), f"backends.{backend}.table is no identifier")
    seen: set[str] = set()
    for i, f in enumerate(config.fields):
        _check_field(f, f"fields[{i}]")
        _need(f.name not in seen, f"fields[{i}]: {f.name!r} is declared twice")
        seen.add(f.name)
    for backend, source in config.backends.items():
        if backend in ROUTED:
            _check_source(config, source, f"backends.{backend}")


def _check_model(model: Model, where: str) -> None:
    name = model.apiKeyEnv.strip()
    _need(
        not name.startswith(KEY_PREFIXES),
        f"{where}.apiKeyEnv looks like a key; it takes the name of the environment variable that holds the key",
    )
    _need(not name or re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name), f"{where}.apiKeyEnv is no name of an environment variable")
    _need(model.protocol in ("", "openai", "anthropic"), f"{where}.protocol must be openai or anthropic")


def _check_field(f: Field, where: str) -> None:
    _need(f.name, f"{where} has no name")
    where = f"{where} ({f.name})"
    _need(f.type in DEFAULT_OPERATORS, f"{where} has the unknown type {f.type!r}")
    _need(not f.itemType or f.itemType in DEFAULT_OPERATORS and f.itemType != "array", f"{where} has the unknown itemType {f.itemType!r}")
    _need(f.type != "enum" or f.values, f"{where} is an enum without values")
    for operator in f.operators:
        _need(operator in OPERATORS, f"{where} lists the unknown operator {operator!r}")
    for backend in ("sql", "mysql", "spark"):
        column = f.mapping.get(backend)
        _need(not column or is_identifier(column), f"{where}: mapping.{backend} is no identifier")
    _need(f.valueCase in ("", "lower", "upper"), f"{where}: valueCase must be lower or upper")
    _need(not f.valueCase or f.textual, f"{where}: valueCase needs a field of text")
    _need(not f.caseInsensitive or f.type == "string", f"{where}: caseInsensitive needs type string")
    _need(not (f.caseInsensitive and f.valueCase), f"{where}: caseInsensitive and valueCase exclude each other")
    for backend, path in f.keywordMapping.items():
        _need(f.textual, f"{where}: keywordMapping needs a field of text")
        _need(is_dot_path(path), f"{where}: keywordMapping.{backend} is no path")
    for backend, path in f.mapping.items():
        _need(not path or backend in ("sql", "mysql", "spark") or is_dot_path(path), f"{where}: mapping.{backend} is no path")
    if f.elemMatch:
        _need(is_dot_path(f.elemMatch), f"{where}: elemMatch is no path")
        inner = [p for b, p in f.mapping.items() if b in ("mongo", "spark") and p]
        _need(inner and all(p.startswith(f.elemMatch + ".") for p in inner), f"{where}: the mapping lies outside elemMatch")
    if f.nestedPath:
        _need(is_dot_path(f.nestedPath), f"{where}: nestedPath is no path")
        inner = [p for b, p in f.mapping.items() if b in ROUTED and p]
        _need(inner and all(p.startswith(f.nestedPath + ".") for p in inner), f"{where}: the mapping lies outside nestedPath")


def _check_source(config: Config, source: Source, where: str) -> None:
    modes = [bool(source.index), bool(source.indexes), bool(source.alias), source.routing is not None]
    _need(sum(modes) <= 1, f"{where} sets more than one of index, indexes, alias and routing")
    for name in [source.index, source.alias, *source.indexes]:
        _need(not name or is_index_name(name), f"{where}: {name!r} is no index name")
    _need(all(source.indexes), f"{where}.indexes has an empty name")
    _need(len(set(source.indexes)) == len(source.indexes), f"{where}.indexes names one twice")
    if source.routing:
        _check_routing(config, source.routing, f"{where}.routing")


def _check_routing(config: Config, routing: Routing, where: str) -> None:
    _need(routing.default, f"{where} needs a default")

    def names(indexes: tuple[str, ...], at: str) -> None:
        _need(indexes, f"{at} has no indexes")
        for name in indexes:
            _need(is_index_name(name), f"{at}: {name!r} is no index name")

    def routed(name: str, at: str) -> Field:
        f = config.find(name)
        _need(f, f"{at}: no field {name!r}")
        _need(f.routingField, f"{at}: {name!r} is not marked routingField")
        return f

    def condition(when: When, at: str) -> None:
        _need(when.field, f"{at} has no field")
        f = routed(when.field, at)
        _need(when.operator in ("equals", "notEquals", "gt", "gte", "lt", "lte"), f"{at}: operator {when.operator!r}")
        ordered = when.operator not in ("equals", "notEquals")
        _need(not ordered or f.type in ("number", "date"), f"{at}: an order needs a number or a date")
        _need(when.value, f"{at} has no value")
        if f.type == "number":
            try:
                float(when.value)
            except ValueError as e:
                raise ConfigError(f"{at}: {when.value!r} is no number") from e
        _need(f.type != "date" or parse_date(when.value), f"{at}: {when.value!r} is no date")
        _need(f.type != "enum" or when.value in f.values, f"{at}: {when.value!r} is no value of the field")

    names(routing.default, f"{where}.default")
    if routing.strategy in ("pattern", "date"):
        _need(routing.field, f"{where} needs a field")
        f = routed(routing.field, where)
        if routing.strategy == "pattern":
            _need(f.type in ("string", "number", "enum", "date"), f"{where}: pattern routing cannot use type {f.type}")
            token = None
        else:
            _need(f.type == "date", f"{where}: date routing needs a date")
            _need(routing.granularity in DATE_TOKENS, f"{where}.granularity must be YEAR, MONTH or DAY")
            token = DATE_TOKENS[routing.granularity]
        found = re.fullmatch(r"([a-z0-9\-_.]*)\{([^{}]+)\}([a-z0-9\-_.]*)", routing.indexPattern)
        _need(found, f"{where}.indexPattern needs one {{token}} among lower-case letters, digits, '-', '_' and '.'")
        _need(token is None or found[2] == token, f"{where}.indexPattern needs the token {{{token}}}")
    elif routing.strategy == "rules":
        _need(routing.rules, f"{where} needs rules")
        seen = set()
        for i, rule in enumerate(routing.rules):
            condition(rule.when, f"{where}.rules[{i}].when")
            names(rule.indexes, f"{where}.rules[{i}]")
            _need((rule.when, rule.priority) not in seen, f"{where}.rules[{i}] repeats a rule at its priority")
            seen.add((rule.when, rule.priority))
    elif routing.strategy == "ifElse":
        _need(routing.branches, f"{where} needs branches")
        for i, branch in enumerate(routing.branches):
            at = f"{where}.branches[{i}]"
            _need(branch.else_ != (branch.if_ is not None), f"{at} needs either if or else")
            _need(not branch.else_ or i == len(routing.branches) - 1, f"{at}: else must come last")
            if branch.if_:
                condition(branch.if_, f"{at}.if")
            names(branch.indexes, at)
    else:
        raise ConfigError(f"{where} has the unknown strategy {routing.strategy!r}")
