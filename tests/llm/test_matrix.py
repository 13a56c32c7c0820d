"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveframe.llm import common, decontaminate, exact_dedup, licenses, lm_score, near_dup, packing, quality, sharding, token_file, tokens, url_rules

from test_operators import LONG, table

TEXTS = ["the house of a tree", "the house of a tree", None, "", " \t ", LONG, "MIT License", "a", "A", "the  house of a tree"]
IDS = [4, 4, None, 7, 8, 9, 10, -3, 11, None]
#: Names that operators use inside, and a name of another case.
CLASHES = ("place", "row", "node", "n", "digest", "shard", "part", "slot", "bits", "words", "hits", "tokens", "score", "kept", "chunk", "kind", "Bucket", "target", "at", "before")

BENCHMARK = [(1, "a tree of the house"), (2, None), (None, "the house of a tree"), (1, "...")]


def trusted(spark):
    return spark.createDataFrame([(i, True) for i in (4, 7, 9)] + [(None, True), (4, True), (10, False)], "doc_id long, trusted boolean")


def bench(spark, rows=BENCHMARK):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("place", F.lit(1))


def token_rows(spark, docs):
    path = common.scratch_path(spark, "matrix")
    token_file.write_token_file(docs, path, tokens.public_path("word_bpe_49k.json"), 2)
    return token_file.read_token_file(spark, path)


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("x://h.org/"), "text").alias("url"), *(c for c in docs.columns if c not in ("doc_id", "text")))


def bad(docs):
    return docs.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") > 7).alias("bad"))


OPERATORS = {
    "op1": lambda spark, docs: quality.classify(common.placed(docs), trusted(spark)),
    "op2": token_rows,
    "op3": lambda spark, docs: url_rules.judge_urls(pages(docs), [("allow", "org", "/the")], bad(docs), min_pages=1),
    "op4": lambda spark, docs: decontaminate.decontaminate(common.placed(docs), bench(spark)),
    "op5": lambda spark, docs: lm_score.cross_entropy_difference(docs, trusted(spark).filter("trusted").select("doc_id")),
    "op6": lambda spark, docs: licenses.scan_licenses(docs),
    "op7": lambda spark, docs: exact_dedup.exact_dedup(docs),
    "op8": lambda spark, docs: packing.pack_documents(docs, tokens.public_path("byte_bpe_50k.json"), 1).filter("start = 0"),
    "op9": lambda spark, docs: near_dup.jaccard_components(docs),
    "op10": lambda spark, docs: sharding.histogram_shards(docs.withColumn("size", F.length("text").cast("long")), 3),
}


def documents(spark, clashes=()):
    docs = table(spark, TEXTS, IDS, lang=F.when(F.col("doc_id") != 4, "en"))
    return docs.withColumns({c: F.lit(c) for c in clashes}).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_keeps_its_result(spark, name):
    rows = OPERATORS[name](spark, documents(spark)).collect()
    key = "page_id" if name == "op3" else "doc_id"
    assert Counter(r[key] for r in rows) == Counter(IDS)
    varying = {"place", "kept", "start", "sequence_id", "slot", "shard"}
    same = [{k: v for k, v in r.asDict().items() if k not in varying} for r in rows if r[key] == 4]
    assert same[0] == same[1]  # the repeated row


@pytest.mark.parametrize("name", OPERATORS)
def test_more_columns_change_nothing(spark, name):
    drop = {"place", "sequence_id", "start", "ids"}
    plain = lambda df: Counter(repr(sorted((k, v) for k, v in r.asDict().items() if k not in drop | set(CLASHES) | {"Kind"})) for r in df.collect())
    assert plain(OPERATORS[name](spark, documents(spark, CLASHES))) == plain(OPERATORS[name](spark, documents(spark)))


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_row(spark, name):
    assert OPERATORS[name](spark, documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["quality", "exact", "near", "clean"])
def test_kept_rows_are_whole(spark, keep):
    docs = documents(spark, CLASHES)
    kept = {
        "quality": lambda: quality.keep_good(docs, trusted(spark)),
        "exact": lambda: exact_dedup.keep_first(docs),
        "near": lambda: near_dup.keep_one(docs),
        "clean": lambda: decontaminate.keep_clean(docs, bench(spark)),
    }[keep]()
    assert kept.columns == docs.columns
    left, all_rows = Counter(map(repr, kept.collect())), Counter(map(repr, docs.collect()))
    assert left <= all_rows and (left.total() < all_rows.total() or keep == "quality")


def test_an_empty_benchmark_hits_nothing(spark):
    for rows in ([], [(1, None), (2, "--")]):
        found = decontaminate.decontaminate(common.placed(documents(spark)), bench(spark, rows)).collect()
        assert len(found) == len(TEXTS) and not any(r.n_hit or r.n_items or r.contaminated or r.spans for r in found)


def test_long_and_repeated_urls(spark):
    urls = ["http://a.example.org/" + "x/" * 40_000, "http://" + "b." * 3_000 + "org/p?q", "http://a.org/é#" + "#" * 9_000] * 2 + [None]
    rows = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("block", "example.org", "/x"), ("allow", "org", "/")], None).collect()
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in rows}
    assert [got[i] for i in range(3)] == [got[i] for i in range(3, 6)] == [(13, 80_001, "example.org/x", "block"), (6_003, 2, "org/", "allow"), (5, 2, "org/", "allow")]
    assert got[6] == (0, 0, None, "allow")


def test_rules_are_those_of_brute_force(spark):
    rng = random.Random(12)
    hosts, words = ["a.example.org", "b.example.org", "c.net"], ["win", "cash", "news", "blog", "shop"]
    urls = [f"http://{rng.choice(hosts)}/{'/'.join(rng.sample(words, rng.randrange(1, 4)))}" for _ in range(160)]
    is_bad = ["win" in u and ("cash" in u or "c.net" in u) or rng.random() < 0.05 for u in urls]
    rows = [(i, u, b) for i, (u, b) in enumerate(zip(urls, is_bad))]
    df = spark.createDataFrame(rows, "row long, url string, bad boolean").withColumns({"tokens": url_rules.tokens_of(F.col("url")), "path": F.lit("")})
    tokens_by = {r.row: frozenset(r.tokens) for r in df.collect()}
    cover = {}
    for item in sorted(set().union(*tokens_by.values())):
        pages_of = frozenset(i for i, t in tokens_by.items() if item in t)
        if len(pages_of) < len(rows) and sum(is_bad[i] for i in pages_of) >= 5:
            cover.setdefault(pages_of, item)
    items = {item: pages_of for pages_of, item in cover.items()}
    rules = {}
    for size in range(1, len(items) + 1):
        for some in itertools.combinations(sorted(items), size):
            pages_of = frozenset.intersection(*(items[x] for x in some))
            support = sum(is_bad[i] for i in pages_of)
            if support >= 5 and support / len(pages_of) >= 0.9:
                rules[some] = (support, len(pages_of), support / len(pages_of))
    left = {x: r for x, r in rules.items() if not any(rules.get(tuple(y for y in x if y != z), (0, 0, 0.0))[2] >= r[2] for z in x)}
    mined = {tuple(r["items"]): (r.support, r.pages, r.confidence) for r in url_rules.mine_rules(df).collect()}
    assert mined == left and len(left) >= 2 and any(len(x) > 1 for x in left)
