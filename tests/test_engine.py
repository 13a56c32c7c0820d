import json
import logging
from datetime import datetime, timezone

import pytest

from sieveframe.engine import Engine, Lazy
from sieveframe.failures import CODES, ModelOutput, UnknownBackend, Unsupported, code_of
from sieveframe.operators.predicates import CompileError
from sieveframe.observe import Event, log_events, raw_excerpt
from sieveframe.planner import first_object, parse_reply, system_prompt
from sieveframe.plans.ast import Query, Sort, ago, all_of, any_of, negate, where
from sieveframe.plans.scope import InvalidScope
from sieveframe.plans.validate import ValidationFailed
from sieveframe.protocol import handle
from sieveframe.providers import Fallback, Kind, ProviderError, Retrying, Stub

NOW = datetime(2031, 3, 9, 18, 30)
CONFIG = {
    "entity": "Reading",
    "backends": {"sql": {"table": "readings"}, "mongo": {"collection": "readings"}, "elasticsearch": {"index": "readings"}},
    "defaults": {"limit": 12, "maxLimit": 90},
    "fields": [
        {"name": "level", "type": "number"},
        {"name": "station", "type": "string", "mapping": {"sql": "station_code"}, "operators": ["equals", "notEquals", "contains", "startsWith", "endsWith", "regex", "in", "notIn"]},
        {"name": "wind", "type": "enum", "values": ["CALM", "GALE"], "indexed": True, "priority": 3},
        {"name": "takenOn", "type": "date", "indexed": True, "priority": 7, "mapping": {"sql": "taken_on"}},
        {"name": "faulty", "type": "boolean"},
        {"name": "marks", "type": "array"},
        {"name": "zone", "type": "string", "caseInsensitive": True},
        {"name": "cluster", "type": "number", "mapping": {"sql": "group"}},
        {"name": "probe", "type": "string", "mapping": {"mongo": "probes.kind", "elasticsearch": "probes.kind"}, "elemMatch": "probes", "nestedPath": "probes"},
        {"name": "volt", "type": "number", "mapping": {"mongo": "probes.volt", "elasticsearch": "probes.volt"}, "elemMatch": "probes", "nestedPath": "probes"},
        {"name": "cellar", "type": "string", "queryable": False, "synonyms": ["basement"]},
    ],
}
CALM = all_of(where("takenOn", "before", ago(-2, "week")), where("marks", "containsAny", ["m", "n"]), where("wind", "notEquals", "GALE"), where("faulty", "equals", True))
QUERY = Query("Reading", filter=CALM, sort=(Sort("level", "ASC"), Sort("takenOn", "DESC")), limit=6)
THEN = datetime(2031, 2, 23, 18, 30, tzinfo=timezone.utc)


@pytest.fixture
def engine():
    return Engine(CONFIG, now=lambda: NOW)


def sql(engine, tree, dialect="sql", **more):
    c = engine.generate(Query("Reading", filter=tree, **more), dialect)
    return c.text, list(c.args)


def test_postgres(engine):
    c = engine.generate(QUERY, "sql")
    assert c.text == "SELECT * FROM readings WHERE (taken_on <= $1 AND wind <> $2 AND marks && ARRAY[$3, $4] AND faulty = $5) ORDER BY level ASC, taken_on DESC LIMIT 6"
    assert c.args == (THEN, "GALE", "m", "n", True)
    assert sql(engine, where("station", "endsWith", "k9")) == ("SELECT * FROM readings WHERE station_code LIKE $1 LIMIT 12", ["%k9"])
    assert sql(engine, where("zone", "in", ["NW", "sE"])) == ("SELECT * FROM readings WHERE LOWER(zone) IN ($1, $2) LIMIT 12", ["nw", "se"])
    assert sql(engine, where("zone", "contains", "W"))[0] == "SELECT * FROM readings WHERE zone ILIKE $1 LIMIT 12"
    assert sql(engine, any_of(negate(where("level", "lte", 0)), where("level", "isNull")))[0] == "SELECT * FROM readings WHERE (level IS NULL OR NOT (level <= $1)) LIMIT 12"
    assert sql(engine, None, select=("level", "cluster"), offset=2)[0] == 'SELECT level, "group" FROM readings LIMIT 12 OFFSET 2'


def test_mysql(engine):
    text, args = sql(engine, all_of(where("station", "regex", "k$"), where("marks", "containsAll", ["m"])), "mysql")
    assert text == "SELECT * FROM readings WHERE (station_code REGEXP ? AND JSON_CONTAINS(marks, ?)) LIMIT 12" and args == ["k$", '["m"]']
    bare = Engine({k: v for k, v in CONFIG.items() if k != "defaults"})
    assert sql(bare, None, "mysql", offset=8)[0].endswith("LIMIT 18446744073709551615 OFFSET 8")


@pytest.mark.parametrize("hostile", ["'", "x' OR 1 = 1 --", '"; DELETE FROM readings', "$1", "?", "%", "\\", "`", "\x00"])
@pytest.mark.parametrize("dialect", ["sql", "mysql"])
def test_values_never_enter_the_text(engine, dialect, hostile):
    plain, _ = sql(engine, where("station", "equals", "k"), dialect)
    assert sql(engine, where("station", "equals", hostile), dialect) == (plain, [hostile])


def test_mongo(engine):
    assert engine.generate(QUERY, "mongo").doc == {
        "collection": "readings",
        "filter": {"takenOn": {"$lte": THEN}, "marks": {"$in": ["m", "n"]}, "wind": {"$ne": "GALE", "$exists": True}, "faulty": True},
        "sort": [["level", 1], ["takenOn", -1]],
        "limit": 6,
    }
    of = lambda tree: engine.generate(Query("Reading", filter=tree), "mongo").doc["filter"]
    assert of(all_of(where("volt", "gte", 3), where("probe", "in", ["p", "q"]))) == {"probes": {"$elemMatch": {"volt": {"$gte": 3.0}, "kind": {"$in": ["p", "q"]}}}}
    assert of(all_of(where("level", "lt", 8), where("level", "lt", 5))) == {"$and": [{"level": {"$lt": 8.0}}, {"level": {"$lt": 5.0}}]}
    assert of(negate(where("faulty", "equals", True))) == {"$and": [{"$nor": [{"faulty": True}]}, {"faulty": {"$exists": True, "$ne": None}}]}
    assert of(any_of(where("zone", "equals", "n.w"), where("marks", "isNull"))) == {"$or": [{"zone": {"$regex": "^n\\.w$", "$options": "i"}}, {"marks": None}]}
    assert json.dumps(of(all_of(*(where("zone", "notIn", [x]) for x in "abc")))).count("$not") == 3


def test_elastic(engine):
    doc = engine.generate(QUERY, "elasticsearch").doc
    assert (doc["path"], doc["sourceType"], doc["body"]["size"]) == ("/readings/_search", "INDEX", 6)
    of = lambda tree: engine.generate(Query("Reading", filter=tree), "elasticsearch").doc["body"]["query"]
    assert of(where("station", "startsWith", "k?")) == {"prefix": {"station": {"value": "k?"}}}
    assert of(where("station", "endsWith", "?k")) == {"wildcard": {"station": {"value": "*\\?k"}}}
    inner = [{"range": {"probes.volt": {"lt": 3.0}}}, {"term": {"probes.kind": "p"}}]
    assert of(all_of(where("volt", "lt", 3), where("probe", "equals", "p"))) == {"bool": {"filter": [{"nested": {"path": "probes", "query": {"bool": {"filter": inner}}}}]}}
    assert engine.generate(Query("Reading"), "opensearch").doc["path"] == "/Reading/_search"


def test_backends_and_scope(engine):
    assert engine.backend_names() == ["elasticsearch", "mongo", "mysql", "opensearch", "sql"]
    with pytest.raises(UnknownBackend):
        engine.generate(QUERY, "cobol")
    c = engine.generate(Query("Reading", filter=where("level", "lt", 1)), "sql", {"owner": 3, "station": ["k", "l"]})
    assert c.text == "SELECT * FROM readings WHERE (owner = $1 AND station_code IN ($2, $3) AND level < $4) LIMIT 12"

    class Count:
        name = "count"

        def generate(self, q, config, now):
            return type(c)("count", text=f"{q.entity} {now:%Y}")

    engine.register(Count())
    assert engine.generate(QUERY, "count").text == "Reading 2031"


def test_lazy_queries(engine):
    q = Lazy(engine).where(where("level", "lt", 1)).where(where("wind", "equals", "CALM")).select("wind").order_by("level", "desc").limit(4)
    assert q.to_sql() == "SELECT wind FROM readings WHERE (wind = $1 AND level < $2) ORDER BY level DESC LIMIT 4"
    assert q.to_args() == ("CALM", 1.0) and q.to_mongo()["limit"] == 4 and "sorted" in q.explain().lower() and len(q.warnings()) == 1
    assert Lazy(engine).to_ast() == {"version": "1.0", "entity": "Reading"}


# --- translation


def reply(tree) -> str:
    return "```json\n" + json.dumps(Query("Reading", filter=tree).to_json()) + "\n```"


GOOD, BAD = reply(where("level", "gt", 5)), reply(where("lvel", "gt", 5))


def test_translation_repairs_and_reports():
    events: list[Event] = []
    stub = Stub("no idea {", BAD, GOOD)
    engine = Engine(CONFIG, provider=stub, now=lambda: NOW)
    engine.set_observer(events.append)
    t = engine.translate("SECRET question", "sql", {"owner": "SECRET-owner"})
    assert t.compiled.text.endswith("(owner = $1 AND level > $2) LIMIT 12") and t.attempts == 3 and t.scope[0].field == "owner"
    assert "owner" not in json.dumps(t.query.to_json())
    assert "perhaps level" in stub.asked[2][1]
    assert [(e.kind, e.outcome) for e in events] == [
        ("model_call", "ok"), ("attempt", "parse_error"), ("model_call", "ok"), ("attempt", "validation_error"), ("model_call", "ok"), ("attempt", "ok"), ("translate", "ok"),
    ]
    assert "SECRET" not in repr(events) and events[-1].scope_keys == ("owner",) and events[-1].repaired


def test_translation_failures():
    def failing(*answers, **more):
        return Engine(CONFIG, provider=Stub(*answers), **more)

    for answers, kind, code, calls in (
        ((BAD,), ValidationFailed, "VALIDATION_FAILED", 3),
        (("none",), ModelOutput, "MODEL_OUTPUT", 3),
        (('{"unsupported": "no totals"}',), Unsupported, "UNSUPPORTED_REQUEST", 1),
        ((ProviderError(Kind.AUTH, "no"),), ProviderError, "MODEL_TRANSPORT", 1),
    ):
        engine = failing(*answers)
        with pytest.raises(kind) as e:
            engine.translate("x", "sql")
        assert code_of(e.value) == code and code in CODES and len(engine.provider.asked) == calls
    engine = failing(GOOD)
    with pytest.raises(InvalidScope):
        engine.translate("x", "sql", {"owner": None})
    assert engine.provider.asked == []
    with pytest.raises(TimeoutError) as e:
        engine.translate("x", "sql", timeout=-1)
    assert code_of(e.value) == "TIMEOUT"


def test_every_way_to_fail_has_its_outcome():
    class Broken:
        name = "broken"

        def generate(self, q, config, now):
            raise CompileError("no such column")

    def last(*answers, backend="sql", **more):
        events, engine = [], Engine(CONFIG, provider=Stub(*answers))
        engine.register(Broken())
        engine.set_observer(events.append)
        with pytest.raises(Exception):  # noqa: B017
            engine.translate("x", backend, **more)
        return events[-1].outcome, [e.outcome for e in events if e.kind == "attempt"], events

    assert last(BAD)[:2] == ("budget_exhausted", ["validation_error"] * 3)
    assert last("none")[:2] == ("budget_exhausted", ["parse_error"] * 3)
    assert last('{"unsupported": "no totals"}')[:2] == ("refusal", ["refusal"])
    assert last(GOOD, backend="broken")[:2] == ("generate_error", ["ok"])
    assert last(GOOD, scope={"owner": None})[:2] == ("caller_error", []) and last(GOOD, backend="none")[:2] == ("caller_error", [])
    outcome, _, events = last(ProviderError(Kind.RATE_LIMIT, "busy", status=429))
    assert outcome == "transport_error" and (events[0].error_kind, events[0].status) == ("rate_limit", 429)
    assert last(GOOD, timeout=-1)[0] == "transport_error"


def test_prompt_shows_only_what_may_be_used():
    text = system_prompt(Engine(CONFIG).config, NOW)
    assert "station" in text and "2031-03-09" in text and '"array"' in text
    for hidden in ("cellar", "basement", "station_code", "probes.kind"):
        assert hidden not in text


@pytest.mark.parametrize("text", ['x {"a": "}"} y', '{"a": {"b": "\\"}"}}', "```{}```"])
def test_first_object(text):
    assert json.loads(first_object(text)) is not None


def test_replies_get_defaults_and_are_never_empty():
    config = Engine(CONFIG).config
    assert parse_reply('{"limit": 3}', config) == Query("Reading", limit=3)
    for text in ("{}", "[]", "{", '{"filter": 3}', ""):
        with pytest.raises(ModelOutput):
            parse_reply(text, config)


def test_retries_and_fallback():
    waits = []
    busy = ProviderError(Kind.RATE_LIMIT, "busy", 3.0)
    down = ProviderError(Kind.UNAVAILABLE, "down")
    assert Retrying(Stub(busy, down, "yes"), sleep=waits.append).complete("", "").text == "yes"
    assert waits[0] == 3.0 and 0.25 <= waits[1] <= 0.5
    with pytest.raises(ProviderError):
        Retrying(Stub(ProviderError(Kind.AUTH, "no")), sleep=waits.append).complete("", "")
    assert len(waits) == 2
    assert Fallback([Stub(down), Stub("b")]).complete("", "").text == "b"
    with pytest.raises(ProviderError):
        Fallback([Stub(down), Stub(busy)]).complete("", "")


def test_log_levels(caplog):
    put = log_events(logging.getLogger("t"))
    with caplog.at_level(logging.DEBUG, "t"):
        for e in (Event("model_call"), Event("attempt", "validation_error"), Event("translate"), Event("translate", "refusal"), Event("translate", "budget_exhausted")):
            put(e)
    assert [r.levelname for r in caplog.records] == ["DEBUG", "WARNING", "INFO", "INFO", "ERROR"]
    assert Event("model_call", total_tokens=5, prompt_tokens=2, completion_tokens=1).hidden_tokens == 2
    assert len(raw_excerpt("é" * 5000).encode()) <= 4096


def test_requests(spark):
    assert handle({"op": "version"}) == {"ok": True, "protocol": "1.1"}
    ask = {"config": CONFIG, "ast": QUERY.to_json()}
    out = handle(ask | {"op": "generate", "backend": "sql"}, now=lambda: NOW)
    assert out["ok"] and out["sql"].startswith("SELECT *") and out["args"][1] == "GALE"
    assert handle(ask | {"op": "validate"})["valid"]
    for more, code in (
        ({"op": "drop"}, "UNKNOWN_OP"),
        ({"op": "generate", "backend": "x"}, "UNKNOWN_BACKEND"),
        ({"op": "generate", "config": {}}, "INVALID_CONFIG"),
        ({"op": "generate", "ast": None}, "INVALID_REQUEST"),
        ({"op": "generate", "ast": Query("Reading", limit=-1).to_json()}, "VALIDATION_FAILED"),
        ({"op": "generate", "scope": {"owner": None}}, "INVALID_SCOPE"),
    ):
        assert handle(ask | {"backend": "sql"} | more)["error"]["code"] == code
    stub = handle({"op": "translate", "config": CONFIG, "query": "x", "backend": "sql"}, provider=Stub(GOOD))
    assert stub["ok"] and stub["ast"]["filter"]["field"] == "level"
    df = spark.createDataFrame([("PLACED",)], "status string")
    made = handle({"op": "generate", "config": {"entity": "T", "fields": [{"name": "status", "type": "string"}]}, "ast": {"entity": "T"}}, spark, {"T": df})
    assert made["schema"]["fields"][0]["name"] == "status"
