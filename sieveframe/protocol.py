"""Requests as plain objects, for callers in other processes: op translate, generate, validate or version."""

from __future__ import annotations

import json
import sys
from typing import Any

from .engine import Engine
from .failures import RETRYABLE, InvalidRequest, code_of
from .plans.ast import query_from
from .plans.explain import explain
from .plans.validate import ValidationFailed
from .providers import Provider

VERSION = "1.1"
MAX_BYTES = 32 << 20


def _answer(engine: Engine, q, compiled, explanation: str) -> dict:
    out = {"backend": compiled.backend, "ast": q.to_json(), "explain": explanation, "warnings": list(compiled.warnings)}
    if compiled.text:
        out |= {"sql": compiled.text, "args": [x.isoformat() if hasattr(x, "isoformat") else x for x in compiled.args]}
    if compiled.doc is not None:
        out["document"] = json.loads(json.dumps(compiled.doc, default=lambda x: x.isoformat()))
    if compiled.df is not None:
        out["schema"] = json.loads(compiled.df.schema.json())
    return out


def handle(request: dict[str, Any], spark=None, tables=None, provider: Provider | None = None, now=None) -> dict[str, Any]:
    """Answer one request; failures come back as {"error": {code, message, retryable}}."""
    try:
        if not isinstance(request, dict):
            raise InvalidRequest("a request is an object")
        op = request.get("op")
        if op == "version":
            return {"ok": True, "protocol": VERSION}
        if op not in ("translate", "generate", "validate"):
            return {"ok": False, "error": {"code": "UNKNOWN_OP", "message": "op must be translate, generate, validate or version", "retryable": False}}
        if not isinstance(request.get("config"), (dict, str)):
            raise InvalidRequest("config is missing")
        engine = Engine(request["config"], spark, tables, provider, now)
        backend = request.get("backend") or ("spark" if spark is not None else "sql")
        if op == "translate":
            if not isinstance(request.get("query"), str) or not request["query"].strip():
                raise InvalidRequest("query is missing")
            t = engine.translate(request["query"], backend, request.get("scope"), request.get("timeoutSeconds"))
            return {"ok": True, **_answer(engine, t.query, t.compiled, t.explanation)}
        if not isinstance(request.get("ast"), dict):
            raise InvalidRequest("ast is missing")
        q = query_from(request["ast"])
        if op == "validate":
            problems = engine.validate(q)
            return {"ok": not problems, "valid": not problems, "errors": [p.to_json() for p in problems]}
        compiled = engine.generate(q, backend, request.get("scope"))
        return {"ok": True, **_answer(engine, q, compiled, explain(engine.apply_scope(q, request.get("scope")), engine.config))}
    except Exception as e:
        code = code_of(e)
        error = {"code": code, "message": str(e) if code != "INTERNAL" else type(e).__name__, "retryable": code in RETRYABLE}
        if isinstance(e, ValidationFailed):
            error["errors"] = [p.to_json() for p in e.problems]
        return {"ok": False, "error": error}


def main() -> int:
    """One request on standard input, one answer on standard output. Exit 0: answered; 1: failed; 2: no request."""
    raw = sys.stdin.buffer.read(MAX_BYTES + 1)
    try:
        if len(raw) > MAX_BYTES:
            raise ValueError("the request is too large")
        request = json.loads(raw)
    except ValueError as e:
        print(json.dumps({"ok": False, "error": {"code": "INVALID_REQUEST", "message": str(e), "retryable": False}}))
        return 2
    answer = handle(request)
    print(json.dumps(answer))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
