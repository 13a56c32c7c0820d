"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the smallest node it is connected with.

    Each round takes the smallest root among neighbours and then the root's own root, so long chains shrink quickly;
    sums of a hot node are combined before the exchange. Rounds are written to the shared folder.
    """
    both = materialise(
        edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "graph-edges",
    )
    roots = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "graph-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        lower = materialise(lower, "graph-lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = materialise(
            lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "graph-roots"
        )
        changed = after.filter("root <> old").limit(1).count()
        forget(roots)
        forget(lower)
        roots = after
        if not changed:
            forget(both)
            return roots.select("node", "root")
