"""From names of sources to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Lookup = Callable[[str], DataFrame]


def lookup(spark: SparkSession, tables: Mapping[str, DataFrame | str] | Lookup | None = None) -> Lookup:
    """How names become DataFrames: a mapping to DataFrames or Parquet paths, a function, or Spark's own catalogue."""
    if callable(tables):
        return tables

    def find(name: str) -> DataFrame:
        found = (tables or {}).get(name)
        if isinstance(found, DataFrame):
            return found
        return spark.read.parquet(found) if found else spark.table(".".join(f"`{x}`" for x in name.split(".")))

    return find


def union_of(names: Iterable[str], find: Lookup) -> DataFrame:
    """The rows of all the tables; a column that some of them lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [find(n) for n in names])
