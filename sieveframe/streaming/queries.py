"""Queries over streaming DataFrames: the same predicates and projection, without what needs the end of the data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..operators.dataframe import filtered, projection
from ..operators.predicates import CompileError, Predicates, quoted
from ..functions.literals import utc
from ..plans.ast import Query
from ..sources.config import Config


def compile_stream(df: DataFrame, q: Query, config: Config, now: datetime | None = None) -> DataFrame:
    """``q`` over a streaming DataFrame. A sort, limit or offset is an error; the config's default limit has no effect."""
    if q.sort or q.limit or q.offset:
        raise CompileError("a stream has no last row: sort, limit and offset do not apply")
    out, shown = filtered(df, q, config, now), projection(q, config)
    if shown is None:
        return out
    predicates = Predicates(config, df.schema, utc(now))
    return out.select(*(quoted(predicates.path(n)) for n in shown))
