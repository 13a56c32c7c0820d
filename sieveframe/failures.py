"""Failure codes of the engine, and which failures are worth another try."""

from __future__ import annotations

from .operators.predicates import CompileError
from .plans.ast import MalformedTree
from .plans.scope import InvalidScope
from .plans.validate import ValidationFailed
from .sources.config import ConfigError
from .sources.routing import RoutingError

#: The failure codes.
CODES = (
    "INVALID_REQUEST", "INVALID_CONFIG", "UNKNOWN_BACKEND", "INVALID_SCOPE", "VALIDATION_FAILED",
    "UNSUPPORTED_REQUEST", "MODEL_OUTPUT", "MODEL_TRANSPORT", "GENERATE_FAILED", "TIMEOUT", "INTERNAL",
)
RETRYABLE = frozenset({"MODEL_OUTPUT", "MODEL_TRANSPORT"})


class UnknownBackend(ValueError):
    pass


class Unsupported(ValueError):
    """The model said that the question cannot be asked of this entity."""


class ModelOutput(ValueError):
    """A reply of the model that holds no query tree."""


class InvalidRequest(ValueError):
    pass


class DeadlinePassed(TimeoutError):
    pass


def code_of(error: BaseException) -> str:
    """The failure code; the order matters where one error wraps another."""
    from .providers import ProviderError

    table = (
        ((DeadlinePassed, TimeoutError), "TIMEOUT"),
        ((InvalidScope,), "INVALID_SCOPE"),
        ((Unsupported,), "UNSUPPORTED_REQUEST"),
        ((ValidationFailed,), "VALIDATION_FAILED"),
        ((ModelOutput,), "MODEL_OUTPUT"),
        ((ProviderError,), "MODEL_TRANSPORT"),
        ((UnknownBackend,), "UNKNOWN_BACKEND"),
        ((ConfigError,), "INVALID_CONFIG"),
        ((InvalidRequest, MalformedTree), "INVALID_REQUEST"),
        ((CompileError, RoutingError), "GENERATE_FAILED"),
    )
    chain, seen = [], error
    while seen is not None and seen not in chain:
        chain.append(seen)
        seen = seen.__cause__
    for kinds, code in table:
        if any(isinstance(e, kinds) for e in chain):
            return code
    return "INTERNAL"
