import json

import pytest
from hypothesis import given, settings, strategies as st

from sieveframe.plans import ast
from sieveframe.plans.ast import MalformedTree, Query, Sort, all_of, ago, any_of, negate, query_from, where
from sieveframe.sources.config import Config, ConfigError, load_config

ORDER = {
    "entity": "Order",
    "fields": [
        {"name": "status", "type": "enum", "values": ["A", "B"]},
        {"name": "amount", "type": "number"},
        {"name": "tags", "type": "array"},
        {"name": "note", "type": "string"},
        {"name": "at", "type": "date", "routingField": True},
        {"name": "tenant", "type": "string", "routingField": True},
    ],
}


def changed(**more) -> dict:
    return json.loads(json.dumps(ORDER)) | more


def with_field(**more) -> dict:
    return changed(fields=[{"name": "x", "type": "string"} | more])


def test_json_round_trip():
    tree = all_of(where("a", "in", [1, "x"]), negate(any_of(where("b", "isNull"), where("c", "after", ago(-3, "day")))))
    q = Query("Order", select=("a",), filter=tree, sort=(Sort("a", "DESC"),), limit=3, offset=0)
    assert query_from(json.loads(json.dumps(q.to_json()))) == q


def test_scoped_flag_is_no_part_of_json():
    assert "scoped" not in json.dumps(ast.Compare("a", "equals", ast.literal(1), scoped=True).to_json())


@pytest.mark.parametrize("raw", [{"filter": []}, {"select": [1]}, {"limit": 1.5}, {"filter": {"type": "logical", "children": {}}}, {"entity": 3}])
def test_wrong_types_are_refused(raw):
    with pytest.raises(MalformedTree):
        query_from(raw)


json_like = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["type", "op", "children", "field", "operator", "value", "kind", "v", "filter"]), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(json_like)
def test_any_json_is_a_tree_or_refused(raw):
    from sieveframe.plans.validate import problems_of

    try:
        q = query_from({"entity": "Order", "filter": raw})
    except MalformedTree:
        return
    config = load_config(ORDER)
    known = all(config.find(c.field) for c in ast.comparisons(q.filter))
    assert problems_of(q, config) or known


def test_conjuncts_skip_alternatives_and_negations():
    tree = all_of(where("a", "equals", 1), all_of(where("b", "equals", 1)), any_of(where("c", "equals", 1)), negate(where("d", "equals", 1)))
    assert [c.field for c in ast.conjuncts(tree)] == ["a", "b"]


@pytest.mark.parametrize(
    ("raw", "told"),
    [
        ({}, "entity"),
        (changed(entity="  "), "entity"),
        (changed(fields=[]), "fields"),
        (changed(surprise=1), "surprise"),
        (changed(fields=[{"name": "a", "type": "string"}] * 2), "twice"),
        (changed(fields=[{"name": "", "type": "string"}]), "no name"),
        (with_field(type="uuid"), "type"),
        (with_field(type="enum"), "values"),
        (with_field(operators=["like"]), "like"),
        (with_field(type="number", valueCase="upper"), "valueCase"),
        (with_field(valueCase="title"), "valueCase"),
        (with_field(type="enum", values=["a"], caseInsensitive=True), "caseInsensitive"),
        (with_field(caseInsensitive=True, valueCase="lower"), "exclude"),
        (with_field(mapping={"sql": "a; drop"}), "identifier"),
        (with_field(mapping={"mongo": "items.sku"}, elemMatch="lines"), "outside"),
        (with_field(mapping={"elasticsearch": "sku"}, nestedPath="items"), "outside"),
        (with_field(type="number", keywordMapping={"elasticsearch": "a"}), "text"),
        (changed(model={"apiKeyEnv": "sk-ant-123456"}), "apiKeyEnv"),
        (changed(model={"apiKeyEnv": "MY-KEY"}), "apiKeyEnv"),
        (changed(model={"protocol": "soap"}), "protocol"),
        (changed(backends={"sql": {"table": "a b"}}), "identifier"),
        (changed(backends={"elasticsearch": {"index": "a", "alias": "b"}}), "more than one"),
        (changed(backends={"elasticsearch": {"indexes": ["a", "a"]}}), "twice"),
        (changed(backends={"elasticsearch": {"index": "Bad"}}), "index name"),
        (changed(backends={"spark": {"routing": {"strategy": "pattern", "field": "tenant", "indexPattern": "t-{tenant}"}}}), "default"),
        (changed(backends={"spark": {"routing": {"strategy": "pattern", "field": "note", "indexPattern": "t-{x}", "default": ["d"]}}}), "routingField"),
        (changed(backends={"spark": {"routing": {"strategy": "date", "field": "at", "granularity": "MONTH", "indexPattern": "t-{yyyy}", "default": ["d"]}}}), "yyyy-MM"),
        (changed(backends={"spark": {"routing": {"strategy": "rules", "default": ["d"]}}}), "rules"),
        (changed(backends={"spark": {"routing": {"strategy": "ifElse", "branches": [{"indexes": ["a"]}], "default": ["d"]}}}), "either"),
        ("{", "JSON"),
    ],
)
def test_unusable_configs_are_refused(raw, told):
    with pytest.raises(ConfigError) as e:
        load_config(raw)
    assert told in str(e.value) and "123456" not in str(e.value)


def test_config_defaults_and_lookups():
    config = load_config(with_field(synonyms=["Ex"], mapping={"sql": "x_col"}))
    assert isinstance(config, Config)
    assert config.synonym("EX").name == "x"
    assert config.physical("x", "spark") == config.physical("x", "mysql") == "x_col"
    assert config.physical("x", "mongo") == config.physical("other", "spark")[:0] + "x"
    assert config.find("x").may_search and not load_config(with_field(type="number")).find("x").may_search
