"""Events about translations, and their way into ``logging``. Questions, scope values and configs never appear."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

#: Outcomes of a step, and the most of a raw reply that an event carries.
OUTCOMES = ("ok", "parse_error", "validation_error", "refusal", "transport_error", "budget_exhausted", "caller_error", "generate_error")
RAW_LIMIT = 4096


@dataclass(frozen=True)
class Event:
    kind: str  # model_call, attempt or translate
    outcome: str = "ok"
    trace_id: str = ""
    backend: str = ""
    entity: str = ""
    attempt: int = 0
    attempts: int = 0
    max_attempts: int = 0
    repaired: bool = False
    duration: float = 0.0
    provider: str = ""
    model: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    finish_reason: str = ""
    retries: int = 0  # calls of the provider that failed before this one ended
    error_kind: str = ""
    status: int = 0  # of the provider's last answer that was an error
    problem_codes: tuple[str, ...] = ()
    scope_keys: tuple[str, ...] = ()
    warnings: int = 0
    failure: str = ""
    error: str = ""
    raw: str = field(default="", repr=False)

    @property
    def hidden_tokens(self) -> int:
        return max(0, self.total_tokens - self.prompt_tokens - self.completion_tokens)


Observer = Callable[[Event], None]


def raw_excerpt(reply: str) -> str:
    """The beginning of a reply, cut at a character."""
    return reply.encode()[:RAW_LIMIT].decode(errors="ignore")


def log_events(logger: logging.Logger | None = None) -> Observer:
    """Steps that went well at DEBUG, failed steps at WARNING, the call's end at INFO, or once at ERROR if it failed."""
    log = logger or logging.getLogger("sieveframe")

    def put(e: Event) -> None:
        if e.kind == "translate":
            level = logging.INFO if e.outcome in ("ok", "refusal") else logging.ERROR
        else:
            level = logging.DEBUG if e.outcome == "ok" else logging.WARNING
        log.log(level, "%s %s entity=%s backend=%s attempt=%d %.1fms %s", e.kind, e.outcome, e.entity, e.backend, e.attempt, 1000 * e.duration, e.failure)

    return put
