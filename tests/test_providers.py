"""Model providers over HTTP, against a server in this process."""

import json
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sieveframe.engine import Engine
from sieveframe.plans.ast import Query, where
from sieveframe.providers import PRESETS, Fallback, Http, Kind, ProviderError, Retrying, kind_of_status, provider_of, seconds_to_wait
from sieveframe.sources.config import ConfigError, load_config

TREE = json.dumps(Query("Probe", filter=where("volt", "lt", 3)).to_json())
OPENAI = {"choices": [{"message": {"content": TREE}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 11, "completion_tokens": 5, "total_tokens": 20}}
ANTHROPIC = {"content": [{"type": "text", "text": TREE[:9]}, {"type": "text", "text": TREE[9:]}], "stop_reason": "end_turn", "usage": {"input_tokens": 7, "output_tokens": 2}}


class Server:
    """Answers with (status, headers, body) one after the other, and keeps what it was asked."""

    def __init__(self):
        self.answers, self.asked = [], []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"]))
                outer.asked.append((self.path, dict(self.headers), json.loads(body)))
                status, headers, answer = outer.answers[min(len(outer.asked), len(outer.answers)) - 1]
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(answer if isinstance(answer, bytes) else json.dumps(answer).encode())

            def log_message(self, *args):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/v9"


@pytest.fixture
def server():
    made = Server()
    yield made
    made.http.shutdown()
    made.http.server_close()


def config(server, **model):
    return load_config({"entity": "Probe", "fields": [{"name": "volt", "type": "number"}], "model": {"provider": "openai", "model": "m-1", "baseURL": server.url} | model})


def http(server, protocol="openai", **model):
    return Http(config(server, **model).model, protocol)


def test_openai_requests(server, monkeypatch):
    monkeypatch.setenv("PROBE_KEY", "k-42")
    server.answers = [(200, {}, OPENAI)]
    reply = http(server, apiKeyEnv="PROBE_KEY", maxTokens=99, jsonMode=True).complete("be brief", "how many")
    assert (reply.text, reply.prompt_tokens, reply.completion_tokens, reply.total_tokens, reply.finish_reason) == (TREE, 11, 5, 20, "stop")
    path, headers, body = server.asked[0]
    headers = {k.lower(): v for k, v in headers.items()}
    assert path == "/v9/chat/completions" and headers["authorization"] == "Bearer k-42"
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["messages"][1]["content"] == "how many"
    assert body["model"] == "m-1" and body["max_tokens"] == 99 and body["response_format"] == {"type": "json_object"}


def test_anthropic_requests(server, monkeypatch):
    monkeypatch.setenv("PROBE_KEY", "k-43")
    server.answers = [(200, {}, ANTHROPIC)]
    reply = http(server, "anthropic", apiKeyEnv="PROBE_KEY").complete("be brief", "how many")
    assert (reply.text, reply.total_tokens, reply.finish_reason) == (TREE, 9, "end_turn")
    path, headers, body = server.asked[0]
    headers = {k.lower(): v for k, v in headers.items()}
    assert path == "/v9/messages" and headers["x-api-key"] == "k-43" and "anthropic-version" in headers
    assert body["system"] == "be brief" and body["messages"] == [{"role": "user", "content": "how many"}] and body["max_tokens"] > 0


@pytest.mark.parametrize(
    ("status", "kind"),
    [(400, Kind.BAD_REQUEST), (401, Kind.AUTH), (403, Kind.AUTH), (404, Kind.NOT_FOUND), (408, Kind.TIMEOUT), (422, Kind.BAD_REQUEST), (429, Kind.RATE_LIMIT), (500, Kind.UNAVAILABLE), (503, Kind.UNAVAILABLE)],
)
def test_statuses(server, status, kind):
    server.answers = [(status, {"Retry-After": "4"}, {"error": "k"})]
    with pytest.raises(ProviderError) as e:
        http(server).complete("", "")
    assert (e.value.kind, e.value.status, e.value.wait) == (kind, status, 4.0) and kind_of_status(status) == kind


@pytest.mark.parametrize("answer", [b"no json", b"[]", {}, {"choices": []}, {"choices": [{"message": None}]}])
def test_answers_of_unknown_form(server, answer):
    server.answers = [(200, {}, answer)]
    with pytest.raises(ProviderError) as e:
        http(server).complete("", "")
    assert e.value.kind is Kind.BAD_RESPONSE and not e.value.kind.retryable


def test_no_server_and_no_time(server):
    server.http.shutdown()
    server.http.server_close()
    with pytest.raises(ProviderError) as e:
        http(server).complete("", "")
    assert e.value.kind is Kind.TRANSPORT
    with pytest.raises(ProviderError) as e:
        http(server).complete("", "", deadline=0.0)
    assert e.value.kind is Kind.TIMEOUT


def test_waits_that_servers_ask_for():
    now = datetime(2031, 3, 9, 18, 30, tzinfo=timezone.utc)
    form = "%a, %d %b %Y %H:%M:%S GMT"
    assert seconds_to_wait((now + timedelta(seconds=75)).strftime(form), now) == 75.0
    assert seconds_to_wait((now - timedelta(days=1)).strftime(form), now) == 0.0
    assert seconds_to_wait("12") == 12.0 and seconds_to_wait("") is None and seconds_to_wait("soon") is None


def test_presets_and_unknown_providers(server):
    for name, base in PRESETS.items():
        made = provider_of(load_config({"entity": "E", "fields": [{"name": "a", "type": "string"}], "model": {"provider": name, "model": "m"}}).model)
        assert made.inner.base == base.rstrip("/") and made.inner.protocol == ("anthropic" if name == "anthropic" else "openai") and made.name == name
    with pytest.raises(ConfigError):
        provider_of(load_config({"entity": "E", "fields": [{"name": "a", "type": "string"}], "model": {"provider": "nobody", "model": "m"}}).model)


def test_events_tell_of_retries_statuses_and_ends(server):
    server.answers = [(429, {}, {}), (200, {}, OPENAI)]
    events = []
    engine = Engine(config(server), provider=Retrying(http(server), sleep=lambda s: None))
    engine.set_observer(events.append)
    assert engine.translate("low probes", "sql").compiled.args == (3.0,)
    assert (events[0].retries, events[0].finish_reason, events[0].total_tokens, events[0].hidden_tokens) == (1, "stop", 20, 4)
    server.answers = [(401, {}, {})]
    with pytest.raises(ProviderError):
        engine.translate("low probes", "sql")
    assert [(e.error_kind, e.status, e.outcome) for e in events if e.kind == "model_call"][-1] == ("auth", 401, "transport_error")


def test_the_next_provider_answers(server):
    server.answers = [(503, {}, {}), (200, {}, OPENAI)]
    both = Fallback([http(server), http(server, provider="groq", model="m-2")])
    assert both.complete("", "").text == TREE and (both.name, both.model) == ("groq", "m-2")
