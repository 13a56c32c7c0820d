"""A validated, scoped query over a DataFrame: filter, projection, sort, paging."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, types as T

from ..functions.literals import utc
from ..plans.ast import Query
from ..plans.explain import page_limit
from ..sources.config import Config
from .predicates import CompileError, Predicates, quoted


def pattern_checker(spark):
    """Raises CompileError for a pattern that Java refuses; Spark itself would fail only when the job runs."""

    def check(pattern: str) -> None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise CompileError("the pattern is no regular expression") from e

    return check


def projection(q: Query, config: Config) -> tuple[str, ...] | None:
    """Logical fields to return; None for all columns, which is possible only where nothing is hidden."""
    if q.select:
        return q.select
    if all(f.may_return for f in config.fields):
        return None
    shown = tuple(f.name for f in config.fields if f.may_return)
    if not shown:
        raise CompileError("the config hides every field")
    return shown


def filtered(df: DataFrame, q: Query, config: Config, now: datetime | None = None) -> DataFrame:
    """``df`` with the filter alone; works on streaming DataFrames too."""
    if q.filter is None:
        return df
    return df.filter(Predicates(config, df.schema, utc(now), pattern_checker(df.sparkSession)).of(q.filter))


def compile_query(df: DataFrame, q: Query, config: Config, now: datetime | None = None) -> DataFrame:
    """A lazy DataFrame with the rows of ``df`` that ``q`` asks for; columns keep their physical names.

    Null order is explicit, as a Postgres backend has it: last in ascending, first in descending order. With a sort
    and a limit Catalyst keeps the top rows of each partition only; without a sort the limit takes any rows.
    """
    predicates = Predicates(config, df.schema, utc(now), pattern_checker(df.sparkSession))
    shown = projection(q, config)
    paths = None if shown is None else [predicates.path(n) for n in shown]
    keys = []
    for s in q.sort:
        path = predicates.path(s.field)
        f = config.find(s.field)
        if f is not None and (f.elemMatch or f.type == "array"):
            raise CompileError(f"{s.field!r} has many values in a row and cannot be sorted by")
        keys.append(quoted(path).desc_nulls_first() if s.dir.upper() == "DESC" else quoted(path).asc_nulls_last())
    out = df if q.filter is None else df.filter(predicates.of(q.filter))
    if keys:
        out = out.orderBy(*keys)
    if q.offset:
        out = out.offset(q.offset)
    if limit := page_limit(q, config):
        out = out.limit(limit)
    return out if paths is None else out.select(*(quoted(p) for p in paths))


def declared_schema_problems(schema: T.StructType, config: Config) -> list[str]:
    """Fields whose column is missing or has another type; checked before a query runs, not while it runs."""
    out = []
    check = Predicates(config, schema, utc(None))
    for f in config.fields:
        try:
            path = check.path(f.name)
            check._inner_type(f.elemMatch, path, f.name) if f.elemMatch and not path.startswith(f.elemMatch + ".") else check._type(path, f, f.name)
        except CompileError as e:
            out.append(str(e))
    return out
