"""Packing by power-of-two decomposition: no sequence holds tokens of two documents, and none is padded.

A document of n ids is cut into ``n // longest`` pieces of the longest length and one piece for every set bit of the
rest, longest first. Equal lengths share a bucket, and each piece is a sequence of its own whose length is a power of
two. Sequences are numbered bucket by bucket, longest first, so a trainer can take batches of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from .common import list_column, materialise, text_or_empty, tidy, trim

PIECES = "doc_id long, start long, length long, doc_tokens long, part int, bucket int, rank long, ids_crc32 long, ids array<int>"


def decompose(n: int, longest: int = 2048) -> list[int]:
    """The lengths of the pieces of a document of ``n`` ids; ``longest`` is a power of two."""
    rest = n % longest
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1] if rest else []
    return [longest] * (n // longest) + bits


#: Texts that are encoded together: fewer than elsewhere, as packing comes after other stages, which leave executors full.
ROWS = 700


def _cut(tokenizer: str, end_id: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode_column
        part, seen = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, counts = encode(batch.column("text"), end_id)
                rows, held, first = [], ids.view(np.uint8).data, 0
                for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                    start = 0
                    for length in decompose(n, longest):
                        bucket = length.bit_length() - 1
                        rows.append((doc, start, length, n, bucket, seen[bucket], zlib.crc32(held[4 * (first + start) : 4 * (first + start + length)])))
                        seen[bucket] += 1
                        start += length
                    first += n
                docs, starts, lengths, totals, buckets, ranks, sums = zip(*rows) if rows else ((),) * 7
                longs = [pa.array(x, type=pa.int64()) for x in (docs, starts, lengths, totals)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *longs,
                        pa.array(np.full(len(rows), part, dtype=np.int32)),
                        pa.array(buckets, type=pa.int32()),
                        pa.array(ranks, type=pa.int64()),
                        pa.array(sums, type=pa.int64()),
                        list_column(np.array(lengths, dtype=np.int64), pa.array(ids.view("<i4"))),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "part", "bucket", "rank", "ids_crc32", "ids"],
                )
        trim()

    return run


@tidy
def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids_crc32 (of the ids
    as little-endian 32-bit integers), ids.

    Reads doc_id and text of ``docs`` and ignores further columns. Null and empty texts give the end id alone;
    repeated and null ids keep their rows; an empty table gives no piece. The pieces are written once to the shared
    folder as they are cut, without an exchange; numbering needs only the counts by bucket and writing task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = materialise(read.mapInArrow(_cut(tokenizer, end_id, longest), PIECES), "pieces")
    before = Window.orderBy(F.desc("bucket"), "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    # Written, so that its size is known when the join is planned: Spark broadcasts it only below its own threshold.
    base = materialise(
        counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1),
        "piece-base",
    )
    return pieces.join(base, ["bucket", "part"]).select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        "bucket",
        (F.col("base") + F.col("rank")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "ids_crc32",
        "ids",
    )
