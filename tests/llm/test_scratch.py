"""What operators leave behind in the shared folder, and where that folder is."""

import os

import pytest
from pyspark.sql import functions as F

from sieveframe.llm import common, exact_dedup, licenses, lm_score, near_dup, quality, sharding, url_rules

from test_operators import table


def left(spark):
    return set(os.listdir(common.shared_folder(spark)))


def labels(spark):
    return spark.createDataFrame([(i, i % 2 == 0) for i in range(9)], "doc_id long, trusted boolean")


OPERATORS = {
    "quality": lambda spark, docs: quality.keep_good(docs.withColumn("lang", F.lit("en")), labels(spark)),
    "near": lambda spark, docs: near_dup.jaccard_components(docs),
    "near_keep": lambda spark, docs: near_dup.keep_one(docs),
    "dedup": lambda spark, docs: exact_dedup.exact_dedup(docs),
    "licenses": lambda spark, docs: licenses.scan_licenses(docs),
    "loss": lambda spark, docs: lm_score.cross_entropy_difference(docs, docs.select("doc_id")),
    "shards": lambda spark, docs: sharding.histogram_shards(docs.withColumn("size", F.length("text").cast("long")), 3),
    "urls": lambda spark, docs: url_rules.judge_urls(docs.select(F.col("doc_id").alias("page_id"), F.lit("a://b.org/c").alias("url")), [("allow", "org", "/")], docs.select(F.col("doc_id").alias("page_id"), F.lit(True).alias("bad"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_only_what_the_result_reads_is_left(spark, name):
    before = left(spark)
    out = OPERATORS[name](spark, table(spark, [f"some words {i % 5} of a text that is long enough" for i in range(12)]))
    read = out.inputFiles()
    made = left(spark) - before
    assert all(any(path in file for file in read) for path in made)
    assert out.count() >= 1


def test_the_folder_comes_from_the_session(spark):
    assert common.shared_folder(spark) == common.shared_folder(spark)
    assert common.scratch_path(spark, "x") != common.scratch_path(spark, "x")

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def __init__(self, folder=None, own=None):
            self.folder, self.own, self._jsc = folder, own, self

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder} if self.folder else {}

        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: self.own is not None
        get = lambda self: self.own

    session = lambda **options: type("Session", (), {"sparkContext": Context(**options)})()
    assert common.shared_folder(session(folder="hdfs://a/b/")) == "hdfs://a/b"
    assert common.shared_folder(session(own="hdfs://c")) == "hdfs://c"
    with pytest.raises(RuntimeError):  # never a folder of one machine on a cluster
        common.shared_folder(session())
