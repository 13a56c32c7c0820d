"""The engine: a config, its backends, and questions or query trees turned into lazy DataFrames or query texts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .failures import DeadlinePassed, ModelOutput, UnknownBackend, Unsupported, code_of
from .functions.literals import utc
from .observe import Event, Observer, raw_excerpt
from .operators.dataframe import compile_query
from .plans.ast import Compare, Query
from .plans.explain import explain, warnings
from .plans.scope import InvalidScope, apply_scope, normalise
from .plans.validate import ValidationFailed, problems_of, validate
from .planner import parse_reply, repair_hint, system_prompt
from .providers import Fallback, Provider, ProviderError, provider_of
from .sources.config import Config, ConfigError, load_config
from .sources.routing import Resolved, resolve_source
from .sources.tables import lookup, union_of


@dataclass(frozen=True)
class Compiled:
    """What a backend makes of a query: a DataFrame, a text with bound arguments, or a document."""

    backend: str
    df: DataFrame | None = None
    text: str = ""
    args: tuple = ()
    doc: dict | None = None
    warnings: tuple[str, ...] = ()
    source: Resolved | None = None


class Backend(Protocol):
    """A pure function of a validated, scoped query: no network and no hidden state."""

    name: str

    def generate(self, q: Query, config: Config, now: datetime) -> Compiled: ...


class SparkBackend:
    """The executing backend. ``tables`` maps source names to DataFrames or Parquet paths; else Spark's catalogue."""

    name = "spark"

    def __init__(self, spark: SparkSession, tables: Any = None):
        self.find = lookup(spark, tables)

    def generate(self, q: Query, config: Config, now: datetime) -> Compiled:
        source = resolve_source(q, config, self.name, now)
        df = compile_query(union_of(source.names, self.find), q, config, now)
        return Compiled(self.name, df=df, warnings=tuple(warnings(q, config)), source=source)


@dataclass(frozen=True)
class Translation:
    """A question's answer: the tree as the model gave it, the effective one, and its compiled form."""

    query: Query
    effective: Query
    compiled: Compiled
    explanation: str
    scope: tuple[Compare, ...] = ()
    attempts: int = 1
    trace_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def df(self) -> DataFrame | None:
        return self.compiled.df


def _outcome(error: Exception) -> str:
    """How a translation that failed with ``error`` ended; parse and validation errors come here when no attempt is left."""
    if isinstance(error, Unsupported):
        return "refusal"
    if isinstance(error, (ModelOutput, ValidationFailed)):
        return "budget_exhausted"
    if isinstance(error, (UnknownBackend, InvalidScope, ConfigError)):
        return "caller_error"
    if isinstance(error, (ProviderError, TimeoutError)):
        return "transport_error"
    return "generate_error"


class Engine:
    def __init__(
        self,
        config: Config | dict | str,
        spark: SparkSession | None = None,
        tables: Any = None,
        provider: Provider | None = None,
        now: Callable[[], datetime] | None = None,
        max_repairs: int = 2,
        scope_in_tree: bool = False,
    ):
        self.config = config if isinstance(config, Config) else load_config(config)
        self.now = (lambda: utc(now() if now else None))
        self.max_repairs, self.scope_in_tree = max_repairs, scope_in_tree
        self.backends: dict[str, Backend] = {}
        self.observer: Observer | None = None
        self._provider = provider
        from .render import TEXT_BACKENDS

        for backend in TEXT_BACKENDS:
            self.register(backend)
        if spark is not None:
            self.register(SparkBackend(spark, tables))

    def register(self, backend: Backend) -> None:
        """Add a backend, or replace the one of its name."""
        self.backends[backend.name] = backend

    def backend_names(self) -> list[str]:
        return sorted(self.backends)

    def set_observer(self, observer: Observer | None) -> None:
        self.observer = observer

    @property
    def provider(self) -> Provider:
        if self._provider is None:
            models = [self.config.model, *self.config.models]
            made = [provider_of(m) for m in models if m.provider or m.baseURL]
            self._provider = made[0] if len(made) == 1 else Fallback(made) if made else provider_of(self.config.model)
        return self._provider

    def validate(self, q: Query) -> list:
        return problems_of(q, self.config)

    def apply_scope(self, q: Query, scope: Mapping[str, Any] | None) -> Query:
        return apply_scope(q, normalise(scope, self.config))

    def _backend(self, name: str) -> Backend:
        if name not in self.backends:
            raise UnknownBackend(f"no backend {name!r}; there are {', '.join(self.backend_names())}")
        return self.backends[name]

    def generate(self, q: Query, backend: str = "spark", scope: Mapping[str, Any] | None = None) -> Compiled:
        """Compile a hand-made query: it is validated, then scoped; the tree itself is left as it is."""
        chosen = self._backend(backend)
        validate(q, self.config)
        return chosen.generate(self.apply_scope(q, scope), self.config, self.now())

    def query(self, q: Query, scope: Mapping[str, Any] | None = None) -> DataFrame:
        return self.generate(q, "spark", scope).df

    def _tell(self, event: Event) -> None:
        if self.observer:
            self.observer(event)

    def translate(self, text: str, backend: str = "spark", scope: Mapping[str, Any] | None = None, timeout: float | None = None) -> Translation:
        """Ask the model for a query tree, repair it at most ``max_repairs`` times, scope and compile it."""
        began = time.monotonic()
        about = {"trace_id": uuid.uuid4().hex, "entity": self.config.entity, "backend": backend, "max_attempts": self.max_repairs + 1}
        try:
            out, attempts = self._translate(text, backend, scope, None if timeout is None else began + timeout, about)
        except Exception as e:
            outcome = _outcome(e)
            self._tell(Event("translate", outcome, duration=time.monotonic() - began, failure=code_of(e), error="" if outcome == "refusal" else type(e).__name__, **about))
            raise
        self._tell(
            Event(
                "translate", duration=time.monotonic() - began, attempts=attempts, repaired=attempts > 1, warnings=len(out.compiled.warnings),
                scope_keys=tuple(c.field for c in out.scope), **about,
            )
        )
        return out

    def _translate(self, text: str, backend: str, scope, deadline: float | None, about: dict) -> tuple[Translation, int]:
        chosen = self._backend(backend)
        predicates = normalise(scope, self.config)  # before any call of the model
        now = self.now()
        system, hint = system_prompt(self.config, now), ""
        for number in range(1, self.max_repairs + 2):
            if deadline is not None and time.monotonic() >= deadline:
                raise DeadlinePassed("the deadline has passed")
            start = time.monotonic()
            try:
                reply = self.provider.complete(system, f"{text}\n\n{hint}" if hint else text, deadline)
            except Exception as e:
                kind, status, retries = (getattr(e, "kind", None), getattr(e, "status", 0), getattr(e, "retries", 0))
                self._tell(
                    Event(
                        "model_call", "transport_error", attempt=number, duration=time.monotonic() - start, provider=self.provider.name, model=self.provider.model,
                        error_kind=kind.value if kind else "", status=status, retries=retries, **about,
                    )
                )
                raise
            self._tell(
                Event(
                    "model_call", attempt=number, duration=time.monotonic() - start, provider=self.provider.name, model=self.provider.model,
                    prompt_tokens=reply.prompt_tokens, completion_tokens=reply.completion_tokens, total_tokens=reply.total_tokens,
                    finish_reason=reply.finish_reason, retries=reply.retries, **about,
                )
            )
            try:
                q = parse_reply(reply.text, self.config)
                validate(q, self.config)
            except Unsupported as e:
                self._tell(Event("attempt", "refusal", attempt=number, failure=code_of(e), **about))
                raise
            except (ModelOutput, ValidationFailed) as e:
                codes = tuple(p.code for p in e.problems) if isinstance(e, ValidationFailed) else ()
                outcome = "validation_error" if codes else "parse_error"
                self._tell(Event("attempt", outcome, attempt=number, problem_codes=codes, raw=raw_excerpt(reply.text), failure=code_of(e), **about))
                if number > self.max_repairs:
                    raise
                hint = repair_hint(e)
                continue
            self._tell(Event("attempt", attempt=number, **about))
            effective = apply_scope(q, predicates)
            compiled = chosen.generate(effective, self.config, now)
            shown = effective if self.scope_in_tree else q
            return Translation(shown, effective, compiled, explain(effective, self.config), tuple(predicates), number, about["trace_id"]), number
        raise AssertionError("no attempt was made")


class Lazy:
    """A query built step by step and compiled when asked: engine-bound, immutable."""

    def __init__(self, engine: Engine, q: Query | None = None, scope: Mapping[str, Any] | None = None):
        self.engine, self.tree, self.scope = engine, q or Query(engine.config.entity), scope

    def _with(self, **change) -> "Lazy":
        return Lazy(self.engine, replace(self.tree, **change), self.scope)

    def select(self, *names: str) -> "Lazy":
        return self._with(select=names)

    def where(self, node) -> "Lazy":
        from .plans.ast import Logic

        old = self.tree.filter
        return self._with(filter=node if old is None else Logic("AND", (old, node)))

    def order_by(self, name: str, direction: str = "ASC") -> "Lazy":
        from .plans.ast import Sort

        return self._with(sort=(*self.tree.sort, Sort(name, direction)))

    def limit(self, n: int) -> "Lazy":
        return self._with(limit=n)

    def offset(self, n: int) -> "Lazy":
        return self._with(offset=n)

    def scoped(self, scope: Mapping[str, Any]) -> "Lazy":
        return Lazy(self.engine, self.tree, scope)

    def compiled(self, backend: str = "spark") -> Compiled:
        return self.engine.generate(self.tree, backend, self.scope)

    def df(self) -> DataFrame:
        return self.compiled().df

    def to_ast(self) -> dict:
        return self.tree.to_json()

    def to_sql(self, dialect: str = "sql") -> str:
        return self.compiled(dialect).text

    def to_args(self, dialect: str = "sql") -> tuple:
        return self.compiled(dialect).args

    def to_mongo(self) -> dict:
        return self.compiled("mongo").doc

    def explain(self) -> str:
        return explain(self.engine.apply_scope(self.tree, self.scope), self.engine.config)

    def warnings(self) -> list[str]:
        return warnings(self.engine.apply_scope(self.tree, self.scope), self.engine.config)
