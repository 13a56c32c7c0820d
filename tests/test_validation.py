"""Every problem code is reached, valid trees pass, and generated patterns are told apart."""

import random

import pytest

from sieveframe.plans.ast import Compare, Logic, Query, Sort, Unknown, Value, ago, all_of, any_of, negate, where
from sieveframe.plans.regexguard import unsafe_part
from sieveframe.plans.validate import CODES, problems_of
from sieveframe.sources.config import load_config

STATION = load_config(
    {
        "entity": "Reading",
        "policy": {"maxNestingDepth": 4, "maxFilterNodes": 12, "maxListLength": 3, "maxValueLength": 27, "maxRegexLength": 7, "allowRegexOn": ["probe", "serial"], "denyRegexOn": ["serial"]},
        "defaults": {"limit": 10, "maxLimit": 80},
        "fields": [
            {"name": "level", "type": "number", "validators": {"min": -40, "max": 60}},
            {"name": "drift", "type": "number", "sortable": False},
            {"name": "takenOn", "type": "date"},
            {"name": "wind", "type": "enum", "values": ["CALM", "GALE", "STORM"]},
            {"name": "faulty", "type": "boolean"},
            {"name": "marks", "type": "array"},
            {"name": "probe", "type": "string", "operators": ["regex", "equals", "contains"]},
            {"name": "serial", "type": "string", "operators": ["regex"]},
            {"name": "alias", "type": "string", "operators": ["regex"]},
            {"name": "remark", "type": "string", "searchable": False},
            {"name": "hidden", "type": "string", "queryable": False},
            {"name": "sealed", "type": "number", "filterable": False, "returnable": False},
        ],
    }
)


def found(q):
    return problems_of(q, STATION)


def reading(tree=None, **more):
    return Query("Reading", filter=tree, **more)


def deep(depth):
    tree = where("faulty", "equals", True)
    for _ in range(depth):
        tree = negate(tree)
    return tree


PROBLEMS = {
    "malformed_ast": [None, reading(Unknown("window")), reading(all_of(None))],
    "unknown_version": [reading(version="0.9")],
    "entity_mismatch": [Query("Probe")],
    "unknown_operator": [reading(Logic("NAND", (deep(0),))), reading(where("level", "near", 4))],
    "invalid_arity": [
        reading(Logic("OR")),
        reading(Logic("NOT", (deep(0), deep(0)))),
        reading(where("level", "between", [3])),
        reading(where("level", "notIn", [])),
    ],
    "nesting_too_deep": [reading(deep(9))],
    "filter_too_large": [reading(any_of(*(where("level", "lt", -k) for k in range(13))))],
    "unknown_field": [reading(where("levle", "lt", 0))],
    "field_not_queryable": [reading(where("hidden", "equals", "k"))],
    "field_not_filterable": [reading(where("sealed", "lte", 2))],
    "field_not_searchable": [reading(where("remark", "endsWith", "k"))],
    "operator_not_allowed": [reading(where("level", "startsWith", "3"))],
    "regex_denied": [reading(where("serial", "regex", "k"))],
    "regex_not_allowed": [reading(where("alias", "regex", "k"))],
    "regex_pattern_long": [reading(where("probe", "regex", "k" * 8))],
    "regex_unsafe": [reading(where("probe", "regex", "(k*)+"))],
    "value_not_allowed": [reading(where("takenOn", "isNotNull", "2020-02-02"))],
    "value_required": [reading(Compare("faulty", "equals"))],
    "kind_mismatch": [
        reading(where("level", "lt", "cold")),
        reading(Compare("level", "lt", Value("number", "7"))),
        reading(where("takenOn", "before", "noon")),
        reading(where("wind", "in", "CALM")),
        reading(where("level", "lt", ago(-3, "week"))),
    ],
    "invalid_relative_date": [reading(where("takenOn", "before", ago(-3, "era"))), reading(where("takenOn", "before", ago(-9_999_999, "year")))],
    "value_out_of_domain": [reading(where("wind", "equals", "BREEZE"))],
    "value_out_of_bounds": [reading(where("level", "between", [-41, 5]))],
    "list_too_long": [reading(where("level", "in", [4, 3, 2, 1]))],
    "value_too_long": [reading(where("probe", "equals", "ü" * 14))],
    "duplicate_field": [reading(select=("wind", "level", "wind"))],
    "field_not_returnable": [reading(select=("sealed",))],
    "field_not_sortable": [reading(sort=(Sort("drift"),)), reading(sort=(Sort("marks"),))],
    "invalid_sort_direction": [reading(sort=(Sort("level", "left"),))],
    "invalid_paging": [reading(limit=-7), reading(offset=-7)],
    "limit_too_large": [reading(limit=81)],
}


@pytest.mark.parametrize(("code", "q"), [(code, q) for code, qs in PROBLEMS.items() for q in qs])
def test_each_problem_has_its_code(code, q):
    assert code in {p.code for p in found(q)}


def test_no_code_is_left_out():
    assert set(PROBLEMS) == set(CODES)


def test_a_payload_counts_and_not_its_tag():
    assert not found(reading(Compare("level", "gte", Value("string", -12.5))))


@pytest.mark.parametrize("seed", range(20))
def test_trees_of_allowed_parts_are_valid(seed):
    rng = random.Random(seed)
    leaves = [
        lambda: where("level", rng.choice(["gt", "lt", "gte", "lte", "equals", "notEquals"]), rng.uniform(-40, 60)),
        lambda: where("wind", "in", rng.sample(["CALM", "GALE", "STORM"], 2)),
        lambda: where("takenOn", rng.choice(["before", "after"]), rng.choice([ago(-rng.randrange(90), "day"), "2021-05-06", "2021-05-06T07:08:09+03:00"])),
        lambda: where("marks", rng.choice(["containsAny", "containsAll"]), ["m", "n"]),
        lambda: where("faulty", rng.choice(["isNull", "isNotNull"])),
        lambda: where("probe", "regex", rng.choice(["^a+b", "[xy]*", "a|b"])),
    ]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaves)()
        return rng.choice([negate(tree(depth - 1)), all_of(tree(depth - 1), tree(0)), any_of(tree(0), tree(0))])

    assert found(reading(tree(3), sort=(Sort(rng.choice(["level", "wind"]), rng.choice(["asc", "DESC"])),), limit=rng.randrange(81), offset=rng.randrange(9))) == []


def test_all_problems_are_told_at_once_with_suggestions():
    told = found(reading(where("winds", "equals", "CALM"), select=("lvel",), limit=-1))
    assert [p.code for p in told] == ["unknown_field", "unknown_field", "invalid_paging"]
    assert [p.suggestions[0] for p in told[:2]] == ["wind", "level"] and told[0].path == "filter"
    assert all("hidden" not in p.suggestions for p in found(reading(where("hiden", "equals", "x"))))


# --- patterns, generated: an endless repetition inside an endless one is unsafe, whatever stands around it

ENDLESS, BOUNDED = ["*", "+", "{3,}", "+?", "*?"], ["", "?", "{4}", "{1,9}"]
ATOMS = ["k", r"\d", "[p-t]", "[*+]", r"\+", "."]


def around(rng, core):
    """The pattern within groups, beside other parts; none of them is repeated without bound."""
    for _ in range(rng.randrange(3)):
        core = rng.choice(["({})", "(?:{})", "q({})?", "({}|z)", "{}[0-9]", "^{}$", r"\({}", "({}){{2}}"]).format(core)
    return core


@pytest.mark.parametrize("seed", range(60))
def test_generated_patterns(seed):
    rng = random.Random(seed)
    atom = rng.choice(ATOMS)
    inner = atom + rng.choice(ENDLESS)
    unsafe = f"({around(rng, inner)}{rng.choice(['', 'w'])}){rng.choice(ENDLESS)}"
    assert unsafe_part(around(rng, unsafe))
    assert unsafe_part(around(rng, f"({inner}){rng.choice(BOUNDED)}")) is None
    assert unsafe_part(around(rng, f"({atom}{rng.choice(BOUNDED)}){rng.choice(ENDLESS)}")) is None


@pytest.mark.parametrize("pattern", ["", "(", ")", "(u+", "u+)*", "[", "u|", "((u)"])
def test_broken_patterns_are_left_to_the_engine(pattern):
    assert unsafe_part(pattern) is None
