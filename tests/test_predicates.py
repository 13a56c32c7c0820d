"""Filters on rows with nulls, for which the driver's tables have none."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sieveframe.engine import Engine
from sieveframe.failures import code_of
from sieveframe.operators.dataframe import declared_schema_problems
from sieveframe.operators.predicates import CompileError
from sieveframe.plans.ast import Compare, Query, Sort, Value, ago, all_of, any_of, negate, where
from sieveframe.sources.config import load_config

CONFIG = {
    "entity": "Row",
    "defaults": {"limit": 100, "maxLimit": 3},
    "fields": [
        {"name": "id", "type": "number"},
        {"name": "name", "type": "string", "caseInsensitive": True, "operators": ["equals", "notEquals", "contains", "startsWith", "endsWith", "in", "notIn", "regex", "isNull", "isNotNull"]},
        {"name": "code", "type": "string", "valueCase": "upper"},
        {"name": "n", "type": "number"},
        {"name": "f", "type": "number", "mapping": {"spark": "f32"}},
        {"name": "d", "type": "number", "mapping": {"spark": "dec"}},
        {"name": "ok", "type": "boolean"},
        {"name": "at", "type": "date"},
        {"name": "day", "type": "date"},
        {"name": "tags", "type": "array"},
        {"name": "nums", "type": "array", "itemType": "number"},
        {"name": "city", "type": "string", "mapping": {"spark": "address.city"}},
        {"name": "sku", "type": "string", "mapping": {"spark": "items.sku"}, "elemMatch": "items"},
        {"name": "price", "type": "number", "mapping": {"spark": "items.price"}, "elemMatch": "items"},
    ],
}
SCHEMA = """id long, name string, code string, n int, f32 float, dec decimal(20,3), ok boolean, at timestamp_ntz, day date,
 tags array<string>, nums array<float>, address struct<city:string>, items array<struct<sku:string,price:double>>"""


@pytest.fixture(scope="module")
def engine(spark):
    from decimal import Decimal

    rows = [
        (1, "Amy", "AB", 5, 0.1, Decimal("1.005"), True, datetime(2024, 1, 31), datetime(2024, 1, 31).date(), ["a", "b"], [0.1], ("X",), [("A", 1.0), ("B", 200.0)]),
        (2, "100%", "CD", 7, 0.5, Decimal("2"), False, datetime(2024, 2, 1, 12), datetime(2024, 2, 1).date(), ["a", None], [], ("Y",), [("A", 150.0)]),
        (3, None, None, None, None, None, None, None, None, None, None, None, None),
        (4, "", "EF", -1, 2.0, Decimal("3"), True, datetime(2023, 12, 31), datetime(2023, 12, 31).date(), [], None, (None,), []),
        (5, "amy_b\\", "GH", 2147483647, 1e9, Decimal("4.5"), False, datetime(2024, 1, 1), datetime(2024, 1, 1).date(), [None], [2.0], ("X",), [(None, 5.0), ("B", None)]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return Engine(CONFIG, spark, {"Row": df}, now=lambda: datetime(2024, 1, 31))


def ids(engine, tree, **more):
    q = Query("Row", filter=tree, limit=0, **more)
    config = load_config(CONFIG | {"defaults": {}})
    return sorted(r.id for r in Engine(config, engine.backends["spark"].find("Row").sparkSession, engine.backends["spark"].find, now=engine.now).query(q).collect())


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        (where("n", "equals", 5), [1]),
        (where("n", "equals", 5.5), []),
        (where("n", "notEquals", 5.5), [1, 2, 4, 5]),
        (where("n", "gt", 6.5), [2, 5]),
        (where("n", "lt", 3e9), [1, 2, 4, 5]),
        (where("n", "notIn", [5]), [2, 4, 5]),
        (negate(where("n", "equals", 5)), [2, 4, 5]),
        (negate(negate(where("n", "equals", 5))), [1]),
        (where("n", "isNull"), [3]),
        (negate(where("n", "isNull")), [1, 2, 4, 5]),
        (where("f", "equals", 0.1), [1]),
        (where("d", "equals", 1.005), [1]),
        (where("d", "in", [2, 4.5]), [2, 5]),
        (where("ok", "notEquals", True), [2, 5]),
        (where("name", "equals", "aMY"), [1]),
        (where("name", "notEquals", "amy"), [2, 4, 5]),
        (where("name", "contains", "%"), [2]),
        (where("name", "contains", "_"), [5]),
        (where("name", "endsWith", "\\"), [5]),
        (where("name", "startsWith", "AM"), [1, 5]),
        (where("name", "startsWith", ""), [1, 2, 4, 5]),
        (where("name", "regex", "^[[:digit:]]+%"), [2]),
        (where("code", "in", ["ab", "Ef"]), [1, 4]),
        (where("at", "before", Value("date", "2024-01-31")), [1, 4, 5]),
        (where("at", "after", Value("date", "2024-02-01T14:00:00+02:00")), [2]),
        (where("at", "after", ago(-30, "day")), [1, 2, 5]),
        (where("day", "equals", Value("date", "2024-01-31")), [1]),
        (where("day", "after", Value("date", "2024-01-31T12:00:00")), [2]),
        (where("at", "between", ["2024-01-01", "2024-01-31"]), [1, 5]),
        (where("tags", "contains", "a"), [1, 2]),
        (negate(where("tags", "contains", "b")), [2, 4, 5]),
        (negate(where("tags", "containsAny", ["b", "c"])), [2, 4, 5]),
        (where("tags", "containsAll", ["a", "b"]), [1]),
        (where("nums", "contains", 0.1), [1]),
        (where("city", "equals", "X"), [1, 5]),
        (where("city", "isNull"), [3, 4]),
        (where("sku", "equals", "A"), [1, 2]),
        (all_of(where("sku", "equals", "A"), where("price", "gt", 100)), [2]),
        (all_of(all_of(where("sku", "equals", "A")), where("price", "gt", 100)), [2]),
        (all_of(where("n", "gt", 0), all_of(where("sku", "equals", "A"), where("price", "gt", 100))), [2]),
        (any_of(where("sku", "equals", "A"), where("price", "equals", 5)), [1, 2, 5]),
        (negate(where("sku", "equals", "A")), [3, 4, 5]),
        (all_of(where("price", "gt", 1), where("price", "gt", 100)), [1, 2]),
        (any_of(where("n", "equals", 5), where("n", "equals", 7), where("ok", "equals", True)), [1, 2, 4]),
        (None, [1, 2, 3, 4, 5]),
    ],
)
def test_rows(engine, tree, expected):
    assert ids(engine, tree) == expected


def test_wide_alternatives_stay_shallow(engine):
    tree = any_of(*(where("n", "gt" if i % 2 else "lt", float(i)) for i in range(400)))
    assert ids(engine, tree) == [1, 2, 4, 5]


def test_limits_and_null_order(engine):
    order = lambda d, **more: [r.id for r in engine.query(Query("Row", select=("id",), sort=(Sort("n", d),), **more)).collect()]
    assert order("ASC") == [4, 1, 2, 5, 3]
    assert order("DESC", limit=2, offset=1) == [5, 2]
    assert order("DESC", limit=0) == [3, 5, 2]  # no limit asked for: the ceiling
    q = Query("Row", limit=2)
    assert engine.query(q).count() == 2 and engine.query(Query("Row")).columns == SCHEMA_NAMES


SCHEMA_NAMES = ["id", "name", "code", "n", "f32", "dec", "ok", "at", "day", "tags", "nums", "address", "items"]


def test_hidden_fields_are_never_returned(spark):
    config = {"entity": "T", "fields": [{"name": "a", "type": "number"}, {"name": "b", "type": "number", "returnable": False}]}
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    assert Engine(config, spark, {"T": df}).query(Query("T")).columns == ["a"]
    hidden = {"entity": "T", "fields": [{"name": "b", "type": "number", "returnable": False}]}
    with pytest.raises(CompileError):
        Engine(hidden, spark, {"T": df}).query(Query("T"))


def test_schema_is_checked_before_a_query_runs(spark):
    config = load_config({"entity": "T", "fields": [{"name": "a", "type": "number"}, {"name": "B", "type": "string"}, {"name": "gone", "type": "date"}]})
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    assert len(declared_schema_problems(df.schema, config)) == 3
    engine = Engine(config, spark, {"T": df})
    for tree in (where("a", "equals", 1), where("B", "equals", "y"), where("gone", "isNull")):
        with pytest.raises(CompileError) as e:
            engine.query(Query("T", filter=tree))
        assert code_of(e.value) == "GENERATE_FAILED"


def test_bad_pattern_fails_at_once(engine):
    with pytest.raises(CompileError):
        engine.query(Query("Row", filter=where("name", "regex", "(")))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").alias("a"), F.lit("x").alias("b"), F.lit(1.5).alias("c")).write.parquet(path)
    config = {"entity": "T", "fields": [{"name": "a", "type": "number"}, {"name": "b", "type": "string"}, {"name": "c", "type": "number"}]}
    df = Engine(config, spark, {"T": path}).query(Query("T", select=("a",), filter=all_of(where("a", "equals", 5), where("b", "contains", "x"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,5)" in plan and "StringContains(b,x)" in plan and "c:double" not in plan.split("ReadSchema")[1]


def test_streams_take_filters_and_projection_only(spark, tmp_path):
    from sieveframe.streaming.queries import compile_stream

    path = str(tmp_path / "s")
    spark.range(6).withColumnRenamed("id", "a").write.parquet(path)
    config = load_config({"entity": "T", "fields": [{"name": "a", "type": "number"}], "defaults": {"limit": 2}})
    stream = spark.readStream.schema("a long").parquet(path)
    q = compile_stream(stream, Query("T", filter=where("a", "gt", 2)), config).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.a for r in spark.table("kept").collect()) == [3, 4, 5]
    with pytest.raises(CompileError):
        compile_stream(stream, Query("T", limit=1), config)


def test_scoped_values_are_data(engine):
    assert engine.generate(Query("Row", filter=where("code", "equals", "x' OR 1=1 --"))).df.count() == 0
    assert Compare("a", "equals", Value("string", "x")).scoped is False
