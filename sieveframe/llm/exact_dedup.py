"""Exact deduplication by a stateful stream whose keyed state lives on disk and never expires.

The state maps a digest of the normalised text to the smallest identifier seen, the locator of that document's text
and the number of arrivals. It is a streaming aggregation in Spark's RocksDB store, checkpointed to the shared folder,
so a restarted stream goes on where it stopped and hot keys are combined before the exchange. Every micro-batch
appends the keys it changed. A digest only nominates: a document whose digest was seen before is compared byte by byte
with the text at the locator, and texts that differ under one digest are grouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WHITE, forget, materialise, placed, scratch_path, settings, text_or_empty, tidy, without

STATE = "digest binary, keep_id long, locator string, arrivals long"
#: A row with a null identifier is ordered after all others.
LAST = (1 << 63) - 1

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # After a commit the state is in the checkpoint; an executor keeps no working copy of all its partitions.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(name: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(name), WHITE, " ")


def update_index(arrivals: DataFrame, index: str, checkpoint: str):
    """Start the stream: ``arrivals`` (streaming; digest, id, locator) into the append-only table at ``index``.

    Each micro-batch writes the keys whose state changed to a folder of its own number, overwriting what a failed
    attempt at the same batch left, so the index is the same whether or not a batch had to be repeated.
    """
    state = arrivals.groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.min_by("locator", "id").alias("locator"), F.count("*").alias("arrivals")
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index}/batch={number}")

    return (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )


def latest(spark: SparkSession, index: str) -> DataFrame:
    """The newest state of every key: digest, keep_id, locator, arrivals."""
    return (
        spark.read.schema(STATE + ", batch long")
        .parquet(index)
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.min_by("locator", "keep_id").alias("locator"), F.max("arrivals").alias("arrivals"))
    )


def _texts_at(locators: DataFrame) -> DataFrame:
    """``locators`` (digest, locator) with ``known``, the normalised text of that row, read from its own file."""
    spark = locators.sparkSession
    locators = materialise(locators, "dedup-older")
    files = [x[0] for x in locators.select(F.substring_index("locator", "#", 1)).distinct().collect()]  # a row per source file
    if not files:
        return locators.withColumn("known", F.lit(""))
    source = placed(spark.read.parquet(*files)).select(F.col("place").alias("locator"), normalised().alias("known"))
    return locators.join(source, "locator").select("digest", "locator", "known")


def _written(path: str, spark: SparkSession) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@tidy
def dedup_rows(
    docs: DataFrame,
    digest=lambda text: F.unhex(F.sha2(text, 256)),
    per_batch: int | None = None,
    root: str | None = None,
    run: str = "run",
) -> DataFrame:
    """exact_dedup() with the column ``place`` beside it; ``docs`` comes from placed()."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "dedup")
    own = F.col("doc_id").cast("long")
    texts = docs.select(
        own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("id"), "place", normalised().alias("full")
    ).withColumn("digest", digest(F.col("full")))
    # What the stream reads: a row per document, without its text.
    seen, arrived = texts.drop("full"), f"{root}/arrivals/{run}"
    if not _written(arrived, spark):  # else this run has begun before, and the stream goes on where it stopped
        seen.write.mode("overwrite").parquet(arrived)
    seen = spark.read.schema(seen.schema).parquet(arrived)
    source = spark.readStream.schema(seen.schema).option("recursiveFileLookup", "true")
    if per_batch:
        source = source.option("maxFilesPerTrigger", per_batch)
    arrivals = source.parquet(f"{root}/arrivals").select("digest", "id", F.col("place").alias("locator"))
    with settings(spark, STORE):
        query = update_index(arrivals, f"{root}/index", f"{root}/checkpoint")
        query.awaitTermination()
    state = materialise(latest(spark, f"{root}/index"), "dedup-state")

    # The texts of hits beside the bytes at their locator; AQE splits a digest that many documents share.
    hits = state.filter("arrivals > 1").select("digest", "locator", "keep_id")
    hit_texts = materialise(texts.join(hits, "digest"), "dedup-hits")
    known = hit_texts.filter("place = locator").select("digest", F.col("full").alias("known"))
    older = hit_texts.select("digest", "locator").distinct().join(known, "digest", "left_anti")  # of earlier runs
    known = known.unionByName(_texts_at(older).select("digest", "known"))
    other = F.when(F.col("full") == F.col("known"), F.lit("")).otherwise(F.concat(F.lit("="), "full"))
    checked = materialise(
        hit_texts.join(known, "digest").select("digest", "place", "doc_id", "id", "locator", "keep_id", other.alias("other")), "dedup-checked"
    )
    forget(hit_texts)
    groups = checked.groupBy("digest", "other").agg(
        F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("group_size")
    )
    # Texts like the one at the locator have the smallest identifier of all runs.
    best = F.when(F.col("other") == "", F.struct(F.col("keep_id").alias("id"), F.col("locator").alias("place"))).otherwise(F.col("first"))
    hit_rows = checked.join(groups, ["digest", "other"]).withColumn("best", best).select(
        "doc_id",
        F.when(F.col("best.id") != LAST, F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.col("best.place") == F.col("place")).alias("kept"),
        "digest",
        "place",
    )
    alone = seen.join(state.filter("arrivals = 1").select("digest"), "digest", "left_semi").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
        "place",
    )
    return alone.unionByName(hit_rows)


@tidy
def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Reads doc_id and text and ignores further columns. Null text counts as empty, and empty texts are equal to each
    other. The row with the smallest doc_id of a group stays; null ids come last, and of rows that repeat an id with
    equal texts exactly one stays. An empty table gives no row. Options: ``digest`` maps a normalised text to binary;
    ``per_batch`` limits the files of a micro-batch, else all there are make one.

    ``root`` names a folder that all executors share, in which the state lives on: a later call with it, and with
    another name as ``run``, meets all documents of the earlier ones, whose Parquet files have to be there still, as hits
    are compared with the text at its locator. The row that stays is then that with the smallest doc_id of all runs so
    far, and group_size counts the rows of this run. A call that broke off is repeated with the same ``root`` and ``run``.
    """
    return dedup_rows(placed(docs), **options).drop("place")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row that stays has; all its columns as they are."""
    return without(docs, lambda located: dedup_rows(located).filter("NOT kept"), "dedup-gone")
