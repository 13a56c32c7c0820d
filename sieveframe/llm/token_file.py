"""Token ids of documents as an ORC data set that can be read in parallel by stripe and pruned by document id.

Layout below the path: ``data`` holds one row per document, in ascending doc_id order over and within the files:
doc_id, part (number of the writing partition), local_start (ids of the partition before it), n_tokens, ids
(array<int>, run-length encoded by ORC's integer encoding). Row indexes and a Bloom filter on doc_id come with every
stripe. ``segments`` has a row per part with the ids of all parts before it, so a document's absolute start is
``base + local_start`` and no pass over the ids is needed to number them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .common import list_column, settings, text_or_empty, trim

DATA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode_column
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, tokens.ROWS):
                batch = whole.slice(at, tokens.ROWS)
                ids, counts = encode(batch.column("text"), end_id)
                starts = start + np.cumsum(counts) - counts
                start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.full(len(counts), part, dtype=np.int32)),
                        pa.array(starts),
                        pa.array(counts),
                        list_column(counts, pa.array(ids.view("<i4"))),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
        trim()

    return run


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    stripe_bytes: int = 16 << 20,
    index_stride: int = 1000,
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text; more columns are ignored) and write the data set.

    Null and empty texts give the end id alone; null ids come first; repeated ids keep a row each, ordered by the
    text's hash; an empty table gives an empty data set. One range exchange of the texts, on (doc_id, hash), so that
    rows which share an id can still be dealt to several tasks.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    data, spark = f"{path}/data", docs.sparkSession
    with settings(spark, tokens.BATCHES):
        (
            ordered.mapInArrow(_encode(tokenizer, end_id), DATA)
            .write.option("orc.bloom.filter.columns", "doc_id")
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", str(index_stride))
            .option("orc.stripe.size", str(stripe_bytes))
            .orc(data)
        )
    sums = spark.read.schema(DATA).orc(data).groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task, not per document
    (
        sums.select("part", "docs", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        .coalesce(1)
        .write.orc(f"{path}/segments")
    )


def read_token_file(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with ``doc_ids`` only those, found through stripe statistics and Bloom filters."""
    data = spark.read.schema(DATA).orc(f"{path}/data")
    if doc_ids is not None:
        data = data.filter(F.col("doc_id").isin(list(doc_ids)))
    base = spark.read.schema("part int, docs long, n long, base long").orc(f"{path}/segments").select("part", "base")
    return data.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def with_ids_crc32(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (all long) and ids_crc32, the checksum of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8)
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)) * 4
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(crc, type=pa.int64())], names=[*keep, "ids_crc32"]
            )

    return df.select(*keep, "ids").mapInArrow(run, ", ".join(f"{c} long" for c in [*keep, "ids_crc32"]))
