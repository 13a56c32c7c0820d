"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, and each result is written as Parquet before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveframe.llm import decontaminate, exact_dedup, near_dup, packing, quality, tokens
from sieveframe.llm.common import scratch_path, table, tidy
from sieveframe.llm.queries import trusted_labels


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, trusted_labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text another one has."""
    return exact_dedup.keep_first(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by n-gram Jaccard similarity."""
    return near_dup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, cut into sequences whose lengths are powers of two."""
    return packing.pack_documents(docs, tokens.public_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", apart),
    ("benchmark decontamination", clean),
    ("packing", packed),
]

#: A language model, a tokenizer and a link graph: SQL cannot express these stages. tests/llm/test_pipeline.py holds each
#: stage, and the whole, against plain Python.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = scratch_path(spark, f"stage-{number}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
