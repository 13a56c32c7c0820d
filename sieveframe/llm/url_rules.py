"""URL filtering by list rules and by association rules that FP-growth mines from labelled pages.

A url becomes a set of tokens. FP-growth finds token sets that are frequent among the pages labelled bad; their
confidence is counted over all labelled pages, and sets below the support or confidence are pruned. The support is a
number of pages, the same at every size of the input, and sets may have any number of tokens; a set is redundant, and
pruned, where one with a token less has the same confidence or more, as that one fits wherever it does. Tokens with
the same pages are one item, so no set is mined twice under other names. List rules and
mined rules share one inverted index: each is filed under one token (a list rule under its host, a mined rule under
its rarest token), pages look their tokens up in it, and candidates are verified in full.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def suffixes(host: Column, labels: int) -> Column:
    """The last one to ``labels`` labels of the host, as tokens."""
    cut = F.split(host, r"\.")
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(labels), F.size(cut))),
            lambda k: F.concat(F.lit("under:"), F.array_join(F.slice(cut, F.size(cut) - k + 1, k), ".")),
        )
    )


def tokens_of(url: Column) -> Column:
    """Scheme, host labels, path segments (digits as one class), query names and whether there is a fragment."""
    url = F.coalesce(url, F.lit(""))
    split = lambda text, by, mark: F.transform(
        F.filter(F.split(text, by), lambda x: x != ""),
        lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")),
    )
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))),
            split(host_of(url), r"\.", "host:"),
            split(path_of(url), "[/._-]+", "path:"),
            split(F.regexp_replace(query, "=[^&]*", ""), "&", "query:"),
            F.when(url.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
        )
    )


def _matches(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``pages`` (row, tokens, path) beside the rules of ``index`` (filed, items, prefix, ...) that fit."""
    return (
        pages.select("row", "path", "tokens", F.explode("tokens").alias("filed"))
        .join(index, "filed")
        .filter(F.forall("items", lambda x: F.array_contains("tokens", x)) & F.startswith("path", F.col("prefix")))
        .drop("tokens", "path", "filed", "items", "prefix")
    )


def _telling(labelled: DataFrame, min_pages: int) -> DataFrame:
    """``labelled`` with ``items``, those of its tokens that can tell pages apart.

    A token of every labelled page changes no support and no confidence, and of tokens that stand on the very same
    pages one speaks for all, so neither is mined; tokens of fewer than ``min_pages`` bad pages are in no rule.
    """
    cover = [F.bit_xor(F.xxhash64("row", F.lit(k))) for k in (0, 1)]  # 128 bits for the set of pages
    tokens = labelled.select("row", "bad", F.explode("tokens").alias("item"))
    found = tokens.groupBy("item").agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad_pages"), *(x.alias(f"c{k}") for k, x in enumerate(cover)))
    (pages,) = labelled.agg(F.count("*")).first()
    found = found.filter((F.col("bad_pages") >= min_pages) & (F.col("pages") < pages))
    kept = materialise(found.groupBy("pages", "c0", "c1").agg(F.min("item").alias("item")).select("item"), "url-items")
    items = tokens.join(kept, "item").groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return materialise(labelled.join(items, "row"), "url-labelled")


def mine_rules(pages: DataFrame, min_pages: int = 5, min_confidence: float = 0.9) -> DataFrame:
    """Rules (items, filed, support, pages, confidence) from ``pages`` (row, path, tokens, bad).

    Support is the number of bad pages with all the items, at least ``min_pages``; confidence the share of bad ones
    among all labelled pages with the items. Of tokens that stand on the very same labelled pages only the first in
    alphabetical order is in rules, and tokens of every labelled page are in none.
    """
    labelled = _telling(materialise(pages.filter("bad IS NOT NULL").select("row", "path", "tokens", "bad"), "url-pages"), min_pages)
    bad = labelled.filter("bad").select("items")
    # Half a page less, so that rounding of the share can't lose a set.
    share = min(max((min_pages - 0.5) / max(bad.count(), 1), 0.0), 1.0)
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(bad).freqItemsets
    sets = sets.filter(F.col("freq") >= min_pages).select(F.array_sort("items").alias("items"), "freq")
    # Each set is filed under its rarest token.
    frequency = labelled.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("pages"))
    filed = (
        sets.select("items", "freq", F.explode("items").alias("item"))
        .join(frequency, "item")
        .groupBy("items")
        .agg(F.min_by("item", F.struct("pages", "item")).alias("filed"), F.first("freq").alias("support"))
        .withColumn("prefix", F.lit(""))
    )
    filed = materialise(filed, "url-sets")
    totals = (
        _matches(labelled.select("row", "path", F.col("items").alias("tokens")), filed.withColumn("rule_items", F.col("items")))
        .groupBy("rule_items")
        .agg(F.count("*").alias("pages"))
        .withColumnRenamed("rule_items", "items")
    )
    sure = filed.join(totals, "items").withColumn("confidence", F.col("support") / F.col("pages")).filter(F.col("confidence") >= min_confidence)
    sure = materialise(sure.select("items", "filed", "support", "pages", "confidence"), "url-sure")
    # Each set beside those with a token less.
    fewer = sure.select("items", "confidence", F.explode("items").alias("item")).withColumn("fewer", F.array_except("items", F.array("item")))
    parts = sure.select(F.col("items").alias("fewer"), F.col("confidence").alias("had"))
    redundant = fewer.join(parts, "fewer").filter(F.col("had") >= F.col("confidence")).select("items").distinct()
    return sure.join(redundant, "items", "left_anti")


@tidy
def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, **mining) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule that is surest of it.

    The last is given by mined_rule (its tokens, null if none fits), support and confidence.

    ``rules`` are (verdict, host, path); the longest that fits decides. Other pages are blocked where a mined rule
    fits and allowed else; ``labels`` has page_id and bad (boolean) for mining, null ids and null labels ignored.
    A null url, or one without ``://``, has an empty host and path. Repeated pages keep a row each, further columns
    are ignored, and empty tables give an empty result.
    """
    spark = pages.sparkSession
    depth = max([1, *(host.count(".") + 1 for _, host, _ in rules)])
    read = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url").select(
        "row", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")
    )
    pages = materialise(read, "url-tokens")
    form = "filed string, items array<string>, prefix string, listed string, verdict string, support long, confidence double"
    index = spark.createDataFrame([(f"under:{host}", [f"under:{host}"], path, host + path, verdict, None, 1.0) for verdict, host, path in rules], form)
    if labels is not None:
        known = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
        mined = mine_rules(pages.join(known, "page_id"), **mining)
        index = index.unionByName(
            mined.select("filed", "items", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("listed"), F.lit("block").alias("verdict"), "support", "confidence")
        )
    index = materialise(index.withColumn("mined", F.when(F.col("listed").isNull(), F.col("items"))), "url-index")
    looked_up = pages.withColumn("tokens", F.concat("tokens", suffixes(F.col("host"), depth)))
    best = _matches(looked_up, index).groupBy("row").agg(
        F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), "listed", "verdict"))).alias("by_list"),
        F.max(F.when(F.col("listed").isNull(), F.struct("confidence", "support", "mined"))).alias("by_rule"),
    )
    return pages.join(best, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("by_list.listed").alias("rule"),
        F.coalesce("by_list.verdict", F.when(F.col("by_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join("by_rule.mined", " ").alias("mined_rule"),
        F.col("by_rule.support").alias("support"),
        F.col("by_rule.confidence").alias("confidence"),
    )
