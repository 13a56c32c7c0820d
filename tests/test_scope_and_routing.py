from datetime import date, datetime, timedelta, timezone

import pytest
from hypothesis import given, settings, strategies as st

from sieveframe.functions.literals import BadLiteral, parse_date, relative_date
from sieveframe.plans.ast import Logic, Query, Value, ago, all_of, any_of, comparisons, negate, where
from sieveframe.plans.explain import explain, page_limit, warnings
from sieveframe.plans.scope import InvalidScope, apply_scope, normalise
from sieveframe.sources.config import load_config
from sieveframe.sources.routing import RoutingError, resolve_source

NOW = datetime(2024, 1, 31)
CONFIG = load_config(
    {
        "entity": "Order",
        "defaults": {"limit": 50},
        "fields": [
            {"name": "wind", "type": "enum", "values": ["A", "B"], "indexed": True},
            {"name": "level", "type": "number", "validators": {"min": 0, "max": 100}, "operators": ["lt"]},
            {"name": "marks", "type": "array"},
            {"name": "tenant", "type": "string", "queryable": False},
            {"name": "at", "type": "date"},
        ],
    }
)


def scoped(tree, scope):
    return apply_scope(Query("Order", filter=tree), normalise(scope, CONFIG))


def test_scope_is_anded_at_the_root_in_key_order():
    tree = any_of(where("level", "lt", 1), where("wind", "equals", "A"))
    q = scoped(tree, {"tenant": "t", "level": 5})
    assert [c.field for c in q.filter.children[:2]] == ["level", "tenant"] and q.filter.op == "AND"
    assert q.filter.children[2] is tree and all(c.scoped for c in q.filter.children[:2])
    assert len(scoped(all_of(where("level", "lt", 1), where("level", "lt", 2)), {"tenant": "t"}).filter.children) == 3
    assert scoped(None, {"tenant": "t"}).filter.field == "tenant"
    assert scoped(tree, None).filter is tree


@pytest.mark.parametrize(
    ("scope", "operator", "payload"),
    [
        ({"tenant": "t"}, "equals", "t"),
        ({"tenant": ["a", "b"]}, "in", ["a", "b"]),
        ({"marks": "x"}, "contains", "x"),
        ({"marks": ["x"]}, "containsAny", ["x"]),
        ({"level": 5}, "equals", 5.0),
        ({"unknown_column": 3}, "equals", 3.0),
        ({" tenant ": "t"}, "equals", "t"),
        ({"at": date(2024, 1, 2)}, "equals", "2024-01-02"),
        ({"at": datetime(2024, 1, 2, tzinfo=timezone.utc)}, "equals", "2024-01-02T00:00:00Z"),
    ],
)
def test_scope_values(scope, operator, payload):
    (c,) = normalise(scope, CONFIG)
    assert (c.operator, c.value.v) == (operator, payload)


@pytest.mark.parametrize(
    "scope",
    [{"": 1}, {"a b": 1}, {"a;--": 1}, {"tenant": None}, {"tenant": []}, {"tenant": b"x"}, {"tenant": {}}, {"tenant": object()}, {"tenant": 5}, {"wind": "C"}, {"level": 101}, {"tenant": "a", " tenant": "b"}, {"other": [1, "a"]}],
)
def test_bad_scopes(scope):
    with pytest.raises(InvalidScope):
        normalise(scope, CONFIG)


def test_scope_messages_hold_no_values():
    with pytest.raises(InvalidScope) as e:
        normalise({"wind": "top-secret-value"}, CONFIG)
    assert "top-secret-value" not in str(e.value)


leaves = st.builds(where, st.sampled_from(["level", "tenant"]), st.just("lt"), st.integers(0, 9))
trees = st.recursive(leaves, lambda x: st.builds(lambda cs: any_of(*cs), st.lists(x, min_size=1, max_size=3)) | st.builds(lambda cs: all_of(*cs), st.lists(x, min_size=1, max_size=3)) | st.builds(negate, x), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_scope_only_narrows(tree):
    q = scoped(tree, {"tenant": "t"})
    first = q.filter.children[0]
    assert isinstance(q.filter, Logic) and q.filter.op == "AND" and first.scoped and first.value.v == "t"
    assert sum(1 for c in comparisons(q.filter)) == 1 + sum(1 for c in comparisons(tree))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-31", datetime(2024, 1, 31)),
        ("2024-01-31T01:02:03", datetime(2024, 1, 31, 1, 2, 3)),
        ("2024-01-31T01:02:03Z", datetime(2024, 1, 31, 1, 2, 3)),
        ("2024-01-31T01:02:03.25+02:00", datetime(2024, 1, 30, 23, 2, 3, 250000)),
        ("2024-13-01", None),
        ("31.01.2024", None),
        ("2024-01-31 01:02:03", None),
    ],
)
def test_dates(text, expected):
    assert parse_date(text) == expected


def test_relative_dates_run_over_short_months():
    assert relative_date(NOW, "month", 1) == datetime(2024, 3, 2)
    assert relative_date(datetime(2024, 2, 29), "year", 1) == datetime(2025, 3, 1)
    assert relative_date(NOW, "week", -1) == datetime(2024, 1, 24)
    assert relative_date(NOW, "month", -13) == datetime(2022, 12, 31)
    for unit, amount in (("decade", 1), ("year", 100_000)):
        with pytest.raises(BadLiteral):
            relative_date(NOW, unit, amount)


def routed(routing, tree, **more):
    config = load_config(
        {
            "entity": "Event",
            "backends": {"elasticsearch": {"routing": routing}},
            "fields": [
                {"name": "tenant", "type": "string", "routingField": True},
                {"name": "at", "type": "date", "routingField": True},
                {"name": "level", "type": "number", "routingField": True},
            ],
        }
    )
    return resolve_source(Query("Event", filter=tree), config, "elasticsearch", NOW).names


PATTERN = {"strategy": "pattern", "field": "tenant", "indexPattern": "t-{tenant}-x", "default": ["all"]}
MONTH = {"strategy": "date", "field": "at", "granularity": "MONTH", "indexPattern": "e-{yyyy-MM}", "default": ["all"]}
RULES = {
    "strategy": "rules",
    "default": ["all"],
    "rules": [
        {"when": {"field": "level", "operator": "gt", "value": "100"}, "indexes": ["big"], "priority": 1},
        {"when": {"field": "tenant", "operator": "equals", "value": "a"}, "indexes": ["a"], "priority": 1},
    ],
}
BRANCHES = {"strategy": "ifElse", "default": ["all"], "branches": [{"if": {"field": "at", "operator": "gte", "value": "2024-01-01"}, "indexes": ["new"]}, {"else": True, "indexes": ["old"]}]}


@pytest.mark.parametrize(
    ("routing", "tree", "names"),
    [
        (PATTERN, where("tenant", "equals", "a"), ("t-a-x",)),
        (PATTERN, any_of(where("tenant", "equals", "a"), where("tenant", "equals", "b")), ("all",)),
        (PATTERN, negate(where("tenant", "equals", "a")), ("all",)),
        (PATTERN, all_of(where("tenant", "equals", "a"), where("tenant", "equals", "b")), ("all",)),
        (PATTERN, None, ("all",)),
        (MONTH, where("at", "equals", Value("date", "2024-01-05")), ("e-2024-01",)),
        (MONTH, where("at", "equals", ago(-1, "month")), ("e-2023-12",)),
        (MONTH, where("at", "between", ["2023-11-30", "2024-01-01"]), ("e-2023-11", "e-2023-12", "e-2024-01")),
        (MONTH, where("at", "after", Value("date", "2024-01-01")), ("all",)),
        (MONTH, where("at", "between", ["1890-01-01", "2020-12-31"]), tuple(f"e-{y}-{m:02d}" for y in range(1890, 2021) for m in range(1, 13))),
        (MONTH | {"granularity": "YEAR", "indexPattern": "e-{yyyy}"}, where("at", "between", ["0001-05-01", "0003-01-01"]), ("e-0001", "e-0002", "e-0003")),
        (RULES, where("level", "gt", 200), ("big",)),
        (RULES, where("level", "lt", 200), ("all",)),  # does not imply amount > 100
        (RULES, where("level", "gt", 100), ("big",)),
        (RULES, where("level", "gte", 100), ("all",)),
        (RULES, where("tenant", "equals", "a"), ("a",)),
        (BRANCHES, where("at", "after", Value("date", "2024-01-01")), ("new",)),
        (BRANCHES, where("at", "before", Value("date", "2024-01-01")), ("old",)),
    ],
)
def test_routing(routing, tree, names):
    assert routed(routing, tree) == names


def test_routing_errors():
    with pytest.raises(RoutingError):
        routed(RULES, all_of(where("level", "gt", 200), where("tenant", "equals", "a")))
    with pytest.raises(RoutingError):
        routed(PATTERN, where("tenant", "equals", "../x"))


def test_explanation_and_warnings():
    q = scoped(any_of(where("level", "lt", 5), where("at", "after", ago(-1, "day"))), {"tenant": "t"})
    text = explain(q, CONFIG)
    assert "Return Order" in text and "level is less than 5 or at is on or after 1 day ago" in text
    assert 'Always scoped to: tenant is "t"' in text and "At most 50 rows" in text
    assert [w.split("'")[1] for w in warnings(q, CONFIG)] == ["tenant", "level", "at"]
    assert page_limit(Query("Order", limit=7), CONFIG) == 7 and page_limit(Query("Order"), CONFIG) == 50


def test_a_range_of_days_names_every_day():
    days = MONTH | {"granularity": "DAY", "indexPattern": "e-{yyyy-MM-dd}"}
    names = routed(days, where("at", "between", ["2023-12-31T23:00:00", "2020-02-27"]))
    first = datetime(2020, 2, 27)
    assert names == tuple(f"e-{(first + timedelta(days=k)):%Y-%m-%d}" for k in range(1404)) and names[-1] == "e-2023-12-31" and "e-2020-02-29" in names
