"""Language-model providers: the interface, HTTP clients for two protocols, retries and fallback."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from enum import Enum
from typing import Protocol

from .sources.config import ConfigError, Model

#: Base addresses of known providers.
PRESETS = {
    "openai": "https://api.openai.com/v1",
    "anthropic": "https://api.anthropic.com/v1",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai",
    "groq": "https://api.groq.com/openai/v1",
    "mistral": "https://api.mistral.ai/v1",
    "deepseek": "https://api.deepseek.com/v1",
    "openrouter": "https://openrouter.ai/api/v1",
    "together": "https://api.together.xyz/v1",
    "fireworks": "https://api.fireworks.ai/inference/v1",
    "xai": "https://api.x.ai/v1",
    "perplexity": "https://api.perplexity.ai",
    "cerebras": "https://api.cerebras.ai/v1",
    "nvidia": "https://integrate.api.nvidia.com/v1",
    "cohere": "https://api.cohere.ai/compatibility/v1",
    "ollama": "http://localhost:11434/v1",
    "lmstudio": "http://localhost:1234/v1",
    "vllm": "http://localhost:8000/v1",
}
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 0.25, 8.0


class Kind(Enum):
    AUTH = "auth"
    BAD_REQUEST = "bad_request"
    NOT_FOUND = "not_found"
    RATE_LIMIT = "rate_limit"
    UNAVAILABLE = "unavailable"
    TIMEOUT = "timeout"
    TRANSPORT = "transport"
    BAD_RESPONSE = "bad_response"
    CONFIG = "config"

    @property
    def retryable(self) -> bool:
        return self in (Kind.RATE_LIMIT, Kind.UNAVAILABLE, Kind.TIMEOUT, Kind.TRANSPORT)


class ProviderError(RuntimeError):
    def __init__(self, kind: Kind, message: str, wait: float | None = None, status: int = 0):
        super().__init__(message)
        self.kind, self.wait, self.status, self.retries = kind, wait, status, 0


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    finish_reason: str = ""
    retries: int = 0


class Provider(Protocol):
    name: str
    model: str

    def complete(self, system: str, user: str, deadline: float | None = None) -> Reply: ...


class Stub:
    """Answers from a list, the last one again and again; errors in it are raised."""

    name, model = "stub", "stub"

    def __init__(self, *answers: str | Exception):
        self.answers, self.asked = list(answers), []

    def complete(self, system: str, user: str, deadline: float | None = None) -> Reply:
        self.asked.append((system, user))
        answer = self.answers[min(len(self.asked), len(self.answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return Reply(answer)


def kind_of_status(status: int) -> Kind:
    if status in (401, 403):
        return Kind.AUTH
    if status == 404:
        return Kind.NOT_FOUND
    if status == 408:
        return Kind.TIMEOUT
    if status == 429:
        return Kind.RATE_LIMIT
    return Kind.UNAVAILABLE if status >= 500 else Kind.BAD_REQUEST


def seconds_to_wait(header: str, now: datetime | None = None) -> float | None:
    """Retry-After: a number of seconds, or a date."""
    if header.strip().isdigit():
        return float(header)
    try:
        at = parsedate_to_datetime(header)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return max(0.0, (at - (now or datetime.now(timezone.utc))).total_seconds())


class Http:
    """A chat endpoint; ``protocol`` is openai or anthropic."""

    def __init__(self, config: Model, protocol: str):
        base = config.baseURL or PRESETS.get(config.provider, "")
        if not base:
            raise ConfigError("model.baseURL is missing and the provider is unknown")
        self.config, self.protocol, self.base = config, protocol, base.rstrip("/")
        self.name, self.model = config.provider or protocol, config.model

    def _request(self, system: str, user: str) -> urllib.request.Request:
        key = os.environ.get(self.config.apiKeyEnv, "") if self.config.apiKeyEnv else ""
        head, body = {"Content-Type": "application/json"}, {"model": self.model, "temperature": self.config.temperature}
        limit = self.config.maxTokens
        if self.protocol == "anthropic":
            head |= {"x-api-key": key, "anthropic-version": "2023-06-01"}
            body |= {"system": system, "messages": [{"role": "user", "content": user}], "max_tokens": limit or 4096}
            url = f"{self.base}/messages"
        else:
            head |= {"Authorization": f"Bearer {key}"} if key else {}
            body |= {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
            body |= {"max_tokens": limit} if limit else {}
            body |= {"response_format": {"type": "json_object"}} if self.config.jsonMode else {}
            url = f"{self.base}/chat/completions"
        return urllib.request.Request(url, json.dumps(body).encode(), head, method="POST")

    def complete(self, system: str, user: str, deadline: float | None = None) -> Reply:
        left = float(self.config.timeoutSeconds or 60)
        if deadline is not None:
            left = min(left, deadline - time.monotonic())
            if left <= 0:
                raise ProviderError(Kind.TIMEOUT, "the deadline has passed")
        try:
            with urllib.request.urlopen(self._request(system, user), timeout=left) as got:
                raw = got.read()
        except urllib.error.HTTPError as e:
            wait = seconds_to_wait(e.headers.get("Retry-After", "") if e.headers else "")
            raise ProviderError(kind_of_status(e.code), f"status {e.code}", wait, e.code) from None
        except TimeoutError as e:
            raise ProviderError(Kind.TIMEOUT, "no answer in time") from e
        except OSError as e:
            raise ProviderError(Kind.TRANSPORT, f"no connection: {type(e).__name__}") from e
        try:
            x = json.loads(raw)
            use = x.get("usage") or {}
            if self.protocol == "anthropic":
                text = "".join(p.get("text", "") for p in x["content"])
                n, m = use.get("input_tokens", 0), use.get("output_tokens", 0)
                return Reply(text, n, m, n + m, x.get("stop_reason") or "")
            first = x["choices"][0]
            text = first["message"]["content"] or ""
            return Reply(text, use.get("prompt_tokens", 0), use.get("completion_tokens", 0), use.get("total_tokens", 0), first.get("finish_reason") or "")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise ProviderError(Kind.BAD_RESPONSE, "the answer has an unknown form") from e


class Retrying:
    """Tries again after retryable errors, waiting longer each time; a server's own wish comes first."""

    def __init__(self, inner: Provider, tries: int = TRIES, first: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.tries, self.first, self.sleep = inner, tries, first, sleep
        self.name, self.model = inner.name, inner.model

    def complete(self, system: str, user: str, deadline: float | None = None) -> Reply:
        for number in range(self.tries):
            try:
                return replace(self.inner.complete(system, user, deadline), retries=number)
            except ProviderError as e:
                e.retries = number
                step = min(self.first * 2**number, LONGEST_WAIT)
                wait = e.wait if e.wait is not None else step / 2 + random.random() * step / 2
                late = deadline is not None and time.monotonic() + wait >= deadline
                if not e.kind.retryable or number + 1 == self.tries or late:
                    raise
                self.sleep(wait)
        raise AssertionError("no try was made")


class Fallback:
    """The first of several providers that answers."""

    def __init__(self, providers: Sequence[Provider]):
        self.providers = list(providers)
        self.name, self.model = self.providers[0].name, self.providers[0].model

    def complete(self, system: str, user: str, deadline: float | None = None) -> Reply:
        last: ProviderError | None = None
        for p in self.providers:
            try:
                out = p.complete(system, user, deadline)
                self.name, self.model = p.name, p.model
                return out
            except ProviderError as e:
                last = e
        raise last


def provider_of(model: Model) -> Provider:
    protocol = model.protocol or ("anthropic" if model.provider == "anthropic" else "openai")
    tries = 1 + (model.maxRetries if model.maxRetries is not None else TRIES - 1)
    return Retrying(Http(model, protocol), tries, (model.retryBackoffMs or 1000 * FIRST_WAIT) / 1000)
