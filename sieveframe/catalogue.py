"""The registered queries over the driver's tables, with their SQL.

Every entry is a query tree over a config and goes through the whole engine: validation, scope, routing, compilation.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .plans.ast import Node, Query, Sort, Value, ago, all_of, any_of, negate, where

NOW = datetime(2024, 1, 31)


def _field(name: str, kind: str, **more) -> dict:
    return {"name": name, "type": kind, **more}


_TEXT_OPS = ["equals", "notEquals", "contains", "startsWith", "endsWith", "in", "notIn", "regex", "isNull", "isNotNull"]
_DATE_OPS = ["before", "after", "between", "equals", "gt", "lt", "isNull", "isNotNull"]

ORDERS = {
    "entity": "Order",
    "backends": {"spark": {"table": "orders"}},
    "fields": [
        _field("id", "number", mapping={"spark": "o_orderkey"}, indexed=True),
        _field("customer", "number", mapping={"spark": "o_custkey"}),
        _field("status", "enum", values=["F", "O", "P"], mapping={"spark": "o_orderstatus"}, synonyms=["state"], priority=10),
        _field("total", "number", mapping={"spark": "o_totalprice"}, synonyms=["amount"]),
        _field("placed", "date", operators=_DATE_OPS, mapping={"spark": "o_orderdate"}),
        _field("urgency", "string", operators=_TEXT_OPS, mapping={"spark": "o_orderpriority"}),
    ],
    "policy": {"denyRegexOn": ["status"]},
}
PARTS = {
    "entity": "Part",
    "backends": {"spark": {"table": "part"}},
    "fields": [
        _field("id", "number", mapping={"spark": "p_partkey"}),
        _field("name", "string", operators=_TEXT_OPS, mapping={"spark": "p_name"}),
        _field("words", "array", mapping={"spark": "p_words"}),
        _field("size", "number", mapping={"spark": "p_size"}),
    ],
}
CUSTOMERS = {
    "entity": "Customer",
    "backends": {"spark": {"table": "customer"}},
    "fields": [
        _field("id", "number", mapping={"spark": "c_custkey"}),
        _field("name", "string", mapping={"spark": "c_name"}),
        _field("nation", "number", mapping={"spark": "c_nationkey"}),
        _field("segment", "string", caseInsensitive=True, mapping={"spark": "c_mktsegment"}),
        _field("segmentUpper", "string", valueCase="upper", mapping={"spark": "c_mktsegment"}, returnable=False),
        _field("balance", "number", mapping={"spark": "c_acctbal"}, returnable=False),
    ],
}
BASKETS = {
    "entity": "Basket",
    "backends": {"spark": {"table": "baskets"}},
    "fields": [
        _field("order", "number", mapping={"spark": "l_orderkey"}),
        _field("part", "number", mapping={"spark": "items.part"}, elemMatch="items"),
        _field("quantity", "number", mapping={"spark": "items.quantity"}, elemMatch="items"),
        _field("flag", "string", mapping={"spark": "items.flag"}, elemMatch="items"),
    ],
}
PLACES = {
    "entity": "Place",
    "backends": {"spark": {"table": "places"}},
    "fields": [
        _field("id", "number", mapping={"spark": "s_suppkey"}),
        _field("name", "string", mapping={"spark": "s_name"}),
        _field("nation", "number", mapping={"spark": "place.nation"}),
        _field("balance", "number", mapping={"spark": "place.account.balance"}),
    ],
}
PAIRS = {
    "entity": "Pair",
    "backends": {"spark": {"table": "pairs"}},
    "fields": [*BASKETS["fields"], _field("tax", "number", mapping={"spark": "taxes.rate"}, elemMatch="taxes")],
}
LIMITED = ORDERS | {"defaults": {"limit": 7, "maxLimit": 30}}
EVENTS = {
    "entity": "Event",
    "backends": {"spark": {"table": "events"}},
    "fields": [
        _field("id", "number", mapping={"spark": "event_id"}),
        _field("at", "date", operators=_DATE_OPS, mapping={"spark": "ts"}, routingField=True),
        _field("kind", "enum", values=["click", "error", "purchase", "signup", "view"], mapping={"spark": "event_type"}, routingField=True),
        _field("value", "number", routingField=True),
    ],
}


def _routed(routing: dict) -> dict:
    return EVENTS | {"backends": {"spark": routing}}


PATTERN = _routed({"routing": {"strategy": "pattern", "field": "kind", "indexPattern": "events-{kind}", "default": ["events-all"]}})
MONTHS = ORDERS | {
    "backends": {
        "spark": {
            "routing": {"strategy": "date", "field": "placed", "granularity": "MONTH", "indexPattern": "orders-{yyyy-MM}", "default": ["orders-all"]}
        }
    },
    "fields": [f | ({"routingField": True} if f["name"] == "placed" else {}) for f in ORDERS["fields"]],
}
RULES = _routed(
    {
        "routing": {
            "strategy": "rules",
            "rules": [
                {"when": {"field": "value", "operator": "gt", "value": "10"}, "indexes": ["events-large"], "priority": 1},
                {"when": {"field": "kind", "operator": "equals", "value": "error"}, "indexes": ["events-error"], "priority": 2},
            ],
            "default": ["events-all"],
        }
    }
)
BRANCHES = _routed(
    {
        "routing": {
            "strategy": "ifElse",
            "branches": [
                {"if": {"field": "kind", "operator": "equals", "value": "view"}, "indexes": ["events-view"]},
                {"else": True, "indexes": ["events-all"]},
            ],
            "default": ["events-all"],
        }
    }
)
TWO_SOURCES = _routed({"indexes": ["events-click", "events-error"]})
ALIASED = _routed({"alias": "events-all"})
DOCUMENTS = {
    "entity": "Document",
    "backends": {"spark": {"table": "documents"}},
    "fields": [_field("id", "number", mapping={"spark": "doc_id"}), _field("text", "string", operators=_TEXT_OPS), _field("lang", "string")],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source: a table of the driver, or one derived from it by a filter or an aggregation."""

    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    if name == "orders_null":
        return read("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    if name == "part":
        return read("part").withColumn("p_words", F.split("p_name", " "))
    if name == "baskets":
        item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
        return read("lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    if name == "places":
        place = F.struct(F.col("s_nationkey").alias("nation"), F.struct(F.col("s_acctbal").alias("balance")).alias("account"))
        return read("supplier").select("s_suppkey", "s_name", place.alias("place"))
    if name == "pairs":
        item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
        return read("lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.collect_list(F.struct(F.col("l_tax").alias("rate"))).alias("taxes"))
    if name == "events-large":
        return read("events").filter("value > 10")
    base, _, rest = name.partition("-")
    if base == "events" and rest not in ("", "all"):
        return read("events").filter(F.col("event_type") == rest)
    if base == "orders" and rest not in ("", "all"):
        begin = datetime.strptime(rest, "%Y-%m")
        end = datetime(begin.year + begin.month // 12, begin.month % 12 + 1, 1)
        at = F.col("o_orderdate")  # bounds that reach the scan
        return read("orders").filter((at >= F.lit(begin).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    return read(base)


def run(config: dict, tree: Node = None, select: tuple = (), sort: tuple = (), limit=None, offset=None, scope=None, table: str | None = None, now: datetime = NOW):
    """A registered query: the engine over the tables of a directory."""
    config = config | {"backends": {"spark": {"table": table}}} if table else config

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(config, spark, lambda name: _table(spark, sf_dir, name), now=lambda: now)
        return engine.query(Query(config["entity"], select=select, filter=tree, sort=tuple(Sort(*s) for s in sort), limit=limit, offset=offset), scope)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(key: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[key], SQL[key] = query, sql


def _orders(key: str, tree: Node, condition: str, **more) -> None:
    _add(key, run(ORDERS, tree, **more), f"SELECT * FROM orders WHERE {condition}")


def _date(text: str) -> Value:
    return Value("date", text)


_add(
    "flagship",
    run(
        ORDERS,
        all_of(where("status", "in", ["O", "P"]), where("total", "gt", 200000), where("placed", "after", _date("1998-01-01"))),
        sort=(("total", "DESC"), ("id",)),
        limit=20,
    ),
    "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1998-01-01' "
    "ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20",
)
_orders("op_equals", where("status", "equals", "F"), "o_orderstatus = 'F'")
_orders("op_not_equals", where("status", "notEquals", "F"), "o_orderstatus <> 'F'")
_orders("op_in", where("status", "in", ["F", "P"]), "o_orderstatus IN ('F', 'P')")
_orders("op_not_in", where("status", "notIn", ["F", "P"]), "o_orderstatus NOT IN ('F', 'P')")
for _key, _operator, _sign in (("op_gt", "gt", ">"), ("op_gte", "gte", ">="), ("op_lt", "lt", "<"), ("op_lte", "lte", "<=")):
    _orders(_key, where("customer", _operator, 70), f"o_custkey {_sign} 70")  # orders of customer 70 are on the bound
_orders("op_between", where("total", "between", [100000, 150000]), "o_totalprice BETWEEN 100000 AND 150000")
_orders("op_equals_whole_number", where("id", "equals", 77), "o_orderkey = 77")
_orders("op_between_reversed", where("total", "between", [150000, 100000]), "o_totalprice BETWEEN 150000 AND 100000")
_orders(
    "op_between_date",
    where("placed", "between", Value("array", ["1996-01-01", "1996-02-01"])),
    "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01'",
)
_orders("op_before", where("placed", "before", _date("1996-01-01")), "o_orderdate <= TIMESTAMP '1996-01-01'")
_orders("op_after", where("placed", "after", _date("2001-01-01T00:00:00Z")), "o_orderdate >= TIMESTAMP '2001-01-01'")
_orders("op_equals_date", where("placed", "equals", _date("1996-01-02")), "o_orderdate = TIMESTAMP '1996-01-02'")
_add("op_relative_date", run(EVENTS, where("at", "after", ago(-7, "day"))), "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-24'")
_add(
    "op_relative_month",
    run(EVENTS, where("at", "before", ago(-1, "month")), now=datetime(2024, 2, 12)),
    "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-12'",
)
_PART = "SELECT p_partkey, p_name FROM part WHERE "
_SHOWN = ("id", "name")
for _key, _tree, _condition in (
    ("op_contains", where("name", "contains", "wid"), "contains(p_name, 'wid')"),
    ("op_starts_with", where("name", "startsWith", "red"), "starts_with(p_name, 'red')"),
    ("op_ends_with", where("name", "endsWith", "get"), "ends_with(p_name, 'get')"),
    ("op_regex", where("name", "regex", "^(red|blue) w"), "regexp_matches(p_name, '^(red|blue) w')"),
    ("op_regex_posix", where("name", "regex", "^[[:alpha:]]+ g"), "regexp_matches(p_name, '^[[:alpha:]]+ g')"),
    ("arr_contains", where("words", "contains", "red"), "list_contains(string_split(p_name, ' '), 'red')"),
    ("arr_contains_any", where("words", "containsAny", ["red", "widget"]), "list_has_any(string_split(p_name, ' '), ['red', 'widget'])"),
    ("arr_contains_all", where("words", "containsAll", ["red", "widget"]), "list_has_all(string_split(p_name, ' '), ['red', 'widget'])"),
    ("not_arr_contains_any", negate(where("words", "containsAny", ["red", "widget"])), "NOT list_has_any(string_split(p_name, ' '), ['red', 'widget'])"),
    ("not_arr_contains_all", negate(where("words", "containsAll", ["red", "widget"])), "NOT list_has_all(string_split(p_name, ' '), ['red', 'widget'])"),
):
    _add(_key, run(PARTS, _tree, select=_SHOWN), _PART + _condition)
_add(
    "op_contains_wildcard_literal",
    run(DOCUMENTS, where("text", "contains", "%"), select=("id", "lang")),
    "SELECT doc_id, lang FROM documents WHERE contains(text, '%')",
)
_NULLS = "SELECT * FROM (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders) WHERE "
for _key, _tree, _condition in (
    ("op_is_null", where("status", "isNull"), "o_orderstatus IS NULL"),
    ("op_is_not_null", where("status", "isNotNull"), "o_orderstatus IS NOT NULL"),
    ("not_equals_null", where("status", "notEquals", "F"), "o_orderstatus <> 'F'"),
    ("not_in_null", where("status", "notIn", ["F"]), "o_orderstatus NOT IN ('F')"),
    (
        "not_and_null",
        negate(all_of(where("status", "equals", "O"), where("total", "gt", 100000))),
        "NOT (o_orderstatus = 'O' AND o_totalprice > 100000)",
    ),
):
    _add(_key, run(ORDERS, _tree, table="orders_null"), _NULLS + _condition)
_LINES = "SELECT DISTINCT l_orderkey FROM lineitem l WHERE "
_LINE = "(SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND {})"
for _key, _tree, _condition in (
    ("nested_single", where("quantity", "gte", 49), "EXISTS " + _LINE.format("m.l_quantity >= 49")),
    (
        "nested_same_element",
        all_of(where("quantity", "gte", 45), where("flag", "equals", "R")),
        "EXISTS " + _LINE.format("m.l_quantity >= 45 AND m.l_returnflag = 'R'"),
    ),
    (
        "nested_or",
        any_of(where("quantity", "gte", 50), where("flag", "equals", "R")),
        f"EXISTS {_LINE.format('m.l_quantity >= 50')} OR EXISTS {_LINE.format(chr(109) + '.l_returnflag = ' + repr('R'))}",
    ),
    ("nested_not", negate(where("flag", "equals", "R")), "NOT EXISTS " + _LINE.format("m.l_returnflag = 'R'")),
):
    _add(_key, run(BASKETS, _tree, select=("order",)), _LINES + _condition)
_add(
    "nested_two_arrays",
    run(PAIRS, all_of(where("quantity", "gte", 45), where("tax", "equals", 0)), select=("order",)),
    _LINES + f"EXISTS {_LINE.format('m.l_quantity >= 45')} AND EXISTS {_LINE.format('m.l_tax = 0')}",
)
_add(
    "struct_path",
    run(PLACES, all_of(where("nation", "in", [1, 7]), where("balance", "gt", 0)), select=("id", "name")),
    "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 7) AND s_acctbal > 0",
)
_add(
    "struct_path_sort",
    run(PLACES, select=("id",), sort=(("balance", "DESC"), ("id",)), limit=9),
    "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey LIMIT 9",
)
_add("limit_default", run(LIMITED, sort=(("id",),)), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
_add("limit_zero_is_the_ceiling", run(LIMITED, sort=(("id",),), limit=0), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 30")
_orders(
    "logic_and",
    all_of(where("status", "equals", "O"), where("total", "lt", 50000)),
    "o_orderstatus = 'O' AND o_totalprice < 50000",
)
_orders(
    "logic_or",
    any_of(where("status", "equals", "P"), where("total", "lt", 20000)),
    "o_orderstatus = 'P' OR o_totalprice < 20000",
)
_orders("logic_or_one_field", any_of(*(where("urgency", "equals", x) for x in ("1-URGENT", "5-LOW"))), "o_orderpriority IN ('1-URGENT', '5-LOW')")
_orders("logic_not", negate(where("total", "gt", 20000)), "NOT (o_totalprice > 20000)")
_orders(
    "logic_deep",
    any_of(
        all_of(where("status", "equals", "F"), negate(any_of(where("total", "lt", 300000), where("urgency", "equals", "5-LOW")))),
        all_of(where("urgency", "startsWith", "1"), where("placed", "before", _date("1995-06-01"))),
    ),
    "(o_orderstatus = 'F' AND NOT (o_totalprice < 300000 OR o_orderpriority = '5-LOW')) "
    "OR (starts_with(o_orderpriority, '1') AND o_orderdate <= TIMESTAMP '1995-06-01')",
)
_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE "
for _key, _tree, _condition in (
    ("ci_equals", where("segment", "equals", "buildING"), "lower(c_mktsegment) = 'building'"),
    ("ci_in", where("segment", "in", ["Building", "machinery"]), "lower(c_mktsegment) IN ('building', 'machinery')"),
    ("ci_not_in", where("segment", "notIn", ["Building", "machinery"]), "lower(c_mktsegment) NOT IN ('building', 'machinery')"),
    ("ci_contains", where("segment", "contains", "uTo"), "contains(lower(c_mktsegment), 'uto')"),
    ("ci_not_equals", where("segment", "notEquals", "building"), "lower(c_mktsegment) <> 'building'"),
    ("ci_starts_with", where("segment", "startsWith", "mAch"), "starts_with(lower(c_mktsegment), 'mach')"),
    ("ci_ends_with", where("segment", "endsWith", "HOLD"), "ends_with(lower(c_mktsegment), 'hold')"),
    ("value_case_upper", where("segmentUpper", "equals", "building"), "c_mktsegment = 'BUILDING'"),
    ("proj_hidden_default", where("balance", "gt", 0), "c_acctbal > 0"),
):
    _add(_key, run(CUSTOMERS, _tree), _CUSTOMER + _condition)
_add("proj_select", run(CUSTOMERS, select=("name", "id")), "SELECT c_name, c_custkey FROM customer")
_add(
    "sort_multi",
    run(ORDERS, sort=(("status", "desc"), ("total", "ASC"), ("id",)), limit=100),
    "SELECT * FROM orders ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice NULLS LAST, o_orderkey LIMIT 100",
)
_add("topk", run(ORDERS, sort=(("total", "DESC"), ("id",)), limit=10), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add(
    "offset_limit",
    run(ORDERS, sort=(("total", "DESC"), ("id",)), limit=20, offset=15),
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15",
)
_add(
    "sort_nulls",
    run(ORDERS, sort=(("status", "DESC"), ("id",)), limit=10, table="orders_null"),
    _NULLS + "true ORDER BY o_orderstatus DESC NULLS FIRST, o_orderkey LIMIT 10",
)
_add(
    "scope_scalar",
    run(CUSTOMERS, where("balance", "gt", 0), scope={"nation": 7}),
    _CUSTOMER + "c_nationkey = 7 AND c_acctbal > 0",
)
_add(
    "scope_list",
    run(CUSTOMERS, where("balance", "gt", 0), scope={"nation": [3, 7]}),
    _CUSTOMER + "c_nationkey IN (3, 7) AND c_acctbal > 0",
)
_add(
    "scope_or_not_escaped",
    run(CUSTOMERS, any_of(where("nation", "equals", 1), where("balance", "lt", 0)), scope={"nation": 7}),
    _CUSTOMER + "c_nationkey = 7 AND (c_nationkey = 1 OR c_acctbal < 0)",
)
_add("scope_undeclared", run(ORDERS, where("status", "equals", "F"), scope={"o_custkey": 10}), "SELECT * FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'F'")
_add("route_pattern", run(PATTERN, where("kind", "equals", "click")), "SELECT * FROM events WHERE event_type = 'click'")
_add("route_pattern_default", run(PATTERN, where("value", "gt", 20)), "SELECT * FROM events WHERE value > 20")
_add(
    "route_date",
    run(MONTHS, where("placed", "between", Value("array", ["1996-01-10", "1996-03-05"]))),
    "SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-10' AND TIMESTAMP '1996-03-05'",
)
_add(
    "route_date_open_range",
    run(MONTHS, where("placed", "after", _date("2001-07-01"))),
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01'",
)
_add(
    "route_rules",
    run(RULES, all_of(where("kind", "equals", "error"), where("value", "gt", 12))),
    "SELECT * FROM events WHERE event_type = 'error' AND value > 12",
)
_add("route_rules_implied", run(RULES, where("value", "lt", 200)), "SELECT * FROM events WHERE value < 200")
_add("route_ifelse", run(BRANCHES, where("kind", "equals", "view")), "SELECT * FROM events WHERE event_type = 'view'")
_add("multi_source", run(TWO_SOURCES, where("value", "gt", 1)), "SELECT * FROM events WHERE event_type IN ('click', 'error') AND value > 1")
_add("alias_source", run(ALIASED, where("value", "gt", 50)), "SELECT * FROM events WHERE value > 50")
