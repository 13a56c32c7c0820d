"""Shared plumbing of the training-data operators: scratch tables, byte folding, Arrow access."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased; all others become a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: A-Z lower-cased, everything else as it is.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

WHITE = r"[\x20\x09-\x0D]+"

_own_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint directory.

    Where neither is set, a folder of this process if Spark runs in it alone (tests), and an error on a cluster.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    own = context._jsc.sc().getCheckpointDir()
    if not found and own.isDefined():
        found = own.get()
    if not found and re.match(r"local(\[|$)", context.master):
        found = _own_scratch.setdefault(context.applicationId, tempfile.mkdtemp(prefix="sieveframe-"))
    if not found:
        raise RuntimeError("no folder that executors share: set spark.checkpoint.dir")
    return found.rstrip("/")


#: Paths that each tidy() function under way has made.
_made: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function, without the scratch tables it made that its result does not read."""

    @wraps(function)
    def run(*args, **options) -> DataFrame:
        _made.append([])
        try:
            out = function(*args, **options)
        finally:
            made = _made.pop()
        read = out.inputFiles()
        for path in made:
            if any(path in file for file in read):
                if _made:  # for the function around this one to delete
                    _made[-1].append(path)
            else:
                delete(out.sparkSession, path)
        return out

    return run


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Texts are long: small batches keep what lies between the JVM and Python small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def materialise(df: DataFrame, name: str, batches: dict[str, str] = BATCHES) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, batches):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that materialise() wrote before its function ends, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What this worker keeps for later tasks of the same kind; what it kept for another kind is dropped."""
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()  # an encoder refers to itself, so only the collector frees it
            trim()
        _held[name] = make()
    return _held[name]


def trim() -> None:
    """Give memory that is free back to the system; called when a task ends, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def list_column(lengths, values: pa.Array) -> pa.Array:
    """A list column from the lengths of its rows and all their values in one array."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


#: The columns that operators on documents read.
READ = ("doc_id", "text", "lang")


def _located(docs: DataFrame, name: str) -> DataFrame:
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return docs.withColumn(name, place)
    except AnalysisException:
        return materialise(docs, "located").withColumn(name, place)


def placed(docs: DataFrame) -> DataFrame:
    """Those columns of ``docs`` which operators read, and ``place``, the file and row number of each row.

    What isn't a plain file scan is written first.
    """
    return _located(docs.select(*(c for c in docs.columns if c.lower() in READ)), "place")


@tidy
def without(docs: DataFrame, found: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``docs`` without the rows whose ``place`` is in ``found`` of its placed() form; all its columns as they are."""
    own = free_name(docs, "place")
    located = _located(docs, own)
    slim = located.select(*(c for c in docs.columns if c.lower() in READ), F.col(own).alias("place"))
    gone = materialise(found(slim).select(F.col("place").alias(own)), name)
    return located.join(gone, own, "left_anti").select(*docs.columns)
