"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveframe.llm import common, decontaminate, exact_dedup, licenses, lm_score, near_dup, packing, quality, regions, sharding, token_file, tokens, url_rules
from sieveframe.llm.graph import components

pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LONG = "long " * 30_000 + "\n" + "x" * 70_000
ODD = ["a b c d", "A b\nc  d", "a b c d", "", None, "  ", "\x00\x1c é\xa0漢字 ʼ", LONG, "a  b\t c d", "é", "Straße 12.5 it's", "a b c d"]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def table(spark, texts, ids=None, **columns):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with names of columns that operators use inside."""
    return table(spark, ODD, row=F.lit("r"), tie=F.lit(1), digest=F.lit("d"), shard=F.lit(-1), lang=F.lit("en")).repartition(3).cache()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- tokens, packing


ALPHABET = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2003", "a", "The", "é", "Straße", "İ", "Σ", "K", "e\u0301", "漢字", "12", "'s", "n't", ".", ",", "!!", "|", "<|endoftext|>", "😀", "ﬁ", "\x00", "\x1c", "\x85", "ñ", "×", "ª", "\u0300"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 64)
    rng = random.Random(7)
    encoder = tokens.ChunkEncoder(tokens.public_path(name), keep=200)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    whole = [np.array(encoder._plain_ids(x), dtype="<u4").tobytes() for x in texts]
    assert encoder.encode(texts) == whole
    for size in (1, 7, 1500):  # a column at a time
        for at in range(0, 1500, size if size > 1 else 300):
            some = texts[at : at + size]
            ids, counts = encoder.encode_column(pa.array([*some, None]), 9)
            parts = np.split(ids, np.cumsum(counts))
            assert [x.astype("<u4").tobytes() for x in parts[:-1]] == [x + b"\x09\0\0\0" for x in [*whole[at : at + size], b""]]
    ids, counts = encoder.encode_column(pa.array([], type=pa.string()), 9)
    assert len(ids) == len(counts) == 0


def ids_of(name, text, end):
    return tokens.encoder(tokens.public_path(name))._plain_ids(text or "") + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_file_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    token_file.write_token_file(odd, path, tokens.public_path("word_bpe_49k.json"), 2)
    got = {r.doc_id: r for r in token_file.read_token_file(spark, path).collect()}
    at = 0
    for n, text in enumerate(ODD):
        ids = ids_of("word_bpe_49k.json", text, 2)
        assert (got[n].start, got[n].n_tokens, got[n].ids) == (at, len(ids), ids)
        at += len(ids)
    some = token_file.read_token_file(spark, path, [3, 7])
    assert {r.doc_id for r in some.collect()} == {3, 7}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    digests = token_file.with_ids_crc32(token_file.read_token_file(spark, path), ["doc_id", "n_tokens"]).collect()
    assert {r.doc_id: r.ids_crc32 for r in digests} == {n: crc(ids_of("word_bpe_49k.json", t, 2)) for n, t in enumerate(ODD)}


def test_token_file_order_repeats_and_nulls(spark, tmp_path):
    path = str(tmp_path / "ids")
    df = table(spark, ["b", "a", "c", "a", "z"], [5, None, 5, 5, -1])
    token_file.write_token_file(df, path, tokens.public_path("word_bpe_49k.json"), 2)
    rows = sorted(token_file.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -1, 5, 5, 5] and [r.start for r in rows] == [0, 2, 4, 6, 8]
    token_file.write_token_file(df.limit(0), path + "0", tokens.public_path("word_bpe_49k.json"), 2)
    assert token_file.read_token_file(spark, path + "0").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 2048, 2049, 6000])
def test_decomposition(n):
    got = packing.decompose(n)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)


def test_packing(spark, odd):
    rows = packing.pack_documents(odd, tokens.public_path("byte_bpe_50k.json"), 1, longest=16).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert r.length == len(r.ids) == 1 << r.bucket and r.offset == 0 and r.ids_crc32 == crc(r.ids)
    for n, text in enumerate(ODD):
        ids = ids_of("byte_bpe_50k.json", text, 1)
        pieces = sorted(by_doc[n], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in order] == list(range(len(rows))) and [r.bucket for r in order] == sorted((r.bucket for r in order), reverse=True)
    assert packing.pack_documents(odd.limit(0), tokens.public_path("byte_bpe_50k.json"), 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, "", 1, longest=3)


# --- url rules


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def test_list_rules_and_odd_urls(spark):
    urls = ["http://A.example.ORG/es/x", "http://example.org/en/12?q", "https://x.org", "http://notorg/", "example.org/es/", None, "", "x://h?a#b", "http://a.org/#://b", "http://example.org/en/2", "http://org/p", "a://b.org/c\nd?e"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("row", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, RULES).collect()}
    for n, url in enumerate(urls):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(FOLD), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert got[n] == (host, path, rule, verdict)
    assert url_rules.judge_urls(df.limit(0), RULES).count() == 0


def test_mined_rules(spark):
    pages = [(i, f"http://casino{i % 3}.example.net/win/{i}" if i % 2 else f"http://site{i % 7}.example.net/news/{i}") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)] + [(None, True), (3, True)], "page_id long, bad boolean")
    rows = url_rules.judge_urls(df, RULES, labels, min_pages=5).collect()
    assert len(rows) == 200 and all((r.verdict == "block") == bool(r.page_id % 2) for r in rows)
    assert all(r.confidence >= 0.9 for r in rows if r.verdict == "block")
    assert url_rules.judge_urls(df, RULES, labels.limit(0)).filter("verdict = 'block'").count() == 0


# --- decontamination


def brute_hits(text, items):
    hit, found, w = set(), set(), words(text)
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 12) if v else 0):
            window = v[i : i + 13]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return w, hit, found


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_decontamination(spark, shard_bytes):
    rng = random.Random(3)
    vocabulary = ["ab", "cd", "éf", "g1", "h"]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 20])))) for n in range(8)] + [(8, "..."), (9, None), (10, "Ab, CD!")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["x " * 40 + items[3][1], items[3][1].upper() + "!", None, "", LONG + " ab-CD", "xab cd", "ab cdx"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(0))
    docs = common.placed(table(spark, texts, extra=F.lit(1)))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, shard_bytes=shard_bytes).collect()}
    for n, text in enumerate(texts):
        w, hit, found = brute_hits(text if text and len(text) < 10_000 else (text or "")[-30:], items)
        r = got[n]
        total = len(words(text))
        assert (r.n_words, r.n_hit, r.n_items) == (total, len(hit), len(found))
        assert r.items_sha256 == sha(",".join(sorted(found))) and r.contaminated == (len(hit) > 0 and 20 * len(hit) >= total)
        raw = (text or "").encode()
        assert [x for a, b in r.spans for x in words(raw[a:b].decode())] == ([w[i] for i in sorted(hit)] if total < 10_000 else ["ab", "cd"][: len(hit)])
        assert len(r.spans) == sum(i - 1 not in hit for i in hit)
    kept = decontaminate.keep_clean(table(spark, texts, extra=F.lit(1)), bench)
    assert {r.doc_id for r in kept.collect()} == {n for n in got if not got[n].contaminated} and kept.columns == ["doc_id", "text", "extra"]


def test_spans_lead_back_to_the_original():
    text = "Éa, B-c  D"
    folded = decontaminate.fold(text.encode()).split()
    spans = decontaminate.original_spans(text.encode(), [1], [3])
    assert folded == ["Éa".encode(), b"b", b"c", b"d"] and text.encode()[slice(*spans[0])] == b"B-c"


# --- licences


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = ["MIT License. mit-license", "the mit. licenses", None, "", mit, "Licensed under CC BY-NC 4.0.", "GNU General Public License", LONG, "apache Apache license", "mit lıcense mit LICENSE", "GENERAL PUBLIC LICENSE, K KIND", "mit licen\u212a", "GNU GENERAL PUBLIC LICENSE. THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE VERSION 3", "MIT LICENSE", "person permission copy software"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, texts, row=F.lit(1), hits=F.lit(2))).collect()}
    for n, text in enumerate(texts):
        w = words(text)
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[n]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert got[4].labels == "mit" and got[4].score > 0.6 and got[5].labels == "cc-by-nc" and got[14].labels == "" and got[0].score == 1 and got[13].labels == "mit"
    assert licenses.scan_licenses(table(spark, texts).limit(0)).count() == 0


def brute_labels(text):
    w, out = words(text), set()
    for label, phrase, notice in licenses.TEMPLATES:
        listed, must = notice.split(), phrase.split()
        start = next(i for i in range(len(listed)) if listed[i : i + len(must)] == must)
        for at in range(len(w) - len(must) + 1):
            if w[at : at + len(must)] == must:
                inside = sum(0 <= at - start + k < len(w) and w[at - start + k] == x for k, x in enumerate(listed))
                if inside >= licenses.COVERAGE * len(listed):
                    out.add((at - start, label, inside / len(listed)))
    return out


def test_licence_templates_by_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(licenses.TEMPLATES)[2].split()
            for k in range(len(notice)):
                if rng.random() < rng.choice([0, 0.1, 0.4]):
                    notice[k] = rng.choice(["the", "kind", "license", notice[k].upper()])
            w += notice[rng.randrange(3) :] + rng.choices(["the", "mit", "of", "x", "general"], k=rng.randrange(5))
        texts.append(rng.choice([" ", "-", ", "]).join(w))
    texts += texts[:2]  # repeated rows
    rows = licenses.scan_licenses(table(spark, texts, [*range(150), 0, 1]).repartition(3)).collect()
    assert len(rows) == 152 and sum(bool(r.found) for r in rows) > 60
    for r in rows:
        expected = brute_labels(texts[r.doc_id])
        assert {(x.offset, x.label, x.share) for x in r.found or []} == expected
        assert r.labels == ",".join(sorted({x[1] for x in expected} | set(filter(None, r.base_labels.split(",")))))


# --- exact duplicates


@pytest.mark.parametrize("digest", [None, lambda text: F.unhex(F.lit("00"))])
def test_exact_dedup(spark, odd, digest):
    more = {"digest": digest} if digest else {}
    docs = odd.drop("digest").unionByName(table(spark, ["a b c d", "", "q"], [None, None, 4]).withColumns({"row": F.lit("r"), "tie": F.lit(1), "shard": F.lit(1), "lang": F.lit("en")}))
    rows = exact_dedup.exact_dedup(docs, **more, per_batch=1).collect()
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    expected = sorted((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g if d is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows if r.doc_id is not None) == expected
    assert len(rows) == docs.count() and sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns


def test_exact_dedup_of_later_runs(spark, tmp_path):
    root = str(tmp_path / "state")

    def run(name, rows, again=False):
        if not again:
            spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/{name}")
        found = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/{name}"), root=root, run=name).collect()
        return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found}

    assert run("monday", [(5, "a b"), (6, "c"), (7, "a  b"), (8, None)]) == {(5, 5, 2, True), (7, 5, 2, False), (6, 6, 1, True), (8, 8, 1, True)}
    tuesday = {(9, 6, 1, False), (3, 3, 1, True), (10, 10, 2, True), (11, 10, 2, False), (12, 8, 1, False)}
    assert run("tuesday", [(9, "c"), (3, "a b"), (10, "new"), (11, "new"), (12, "")]) == tuesday
    assert run("tuesday", [], again=True) == tuesday
    assert run("wednesday", [(20, "a b"), (21, "new")]) == {(20, 3, 1, False), (21, 10, 1, False)}


def test_exact_dedup_of_nothing(spark, odd):
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


# --- near duplicates


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts(rng):
    vocabulary = [f"w{i}" for i in range(200)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 30)]
    out = list(ODD)
    for copies in (2, 3, 30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 80]))] + rng.choice(passages)
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            out.append(" ".join(x))
    for p in passages:
        out += [" ".join(p + [rng.choice(vocabulary) for _ in range(rng.randrange(9))]) for _ in range(10)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, leaf, often, crowd", [(1, 512, 8, 20_000), (2, 3, 2, 5), (3, 2, 3, 3)])
def test_jaccard_components(spark, seed, leaf, often, crowd):
    options = {"leaf": leaf, "often": often, "crowd": crowd, "chunk": 900}
    texts = near_texts(random.Random(seed))
    docs = table(spark, texts, node=F.lit(1), n=F.lit(2)).repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.jaccard_components(docs, **options).collect()}
    expected = brute_components(texts)
    assert got == expected
    kept = near_dup.keep_one(docs, **options)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()}) and kept.columns == docs.columns


def test_jaccard_of_repeats_and_nothing(spark):
    rows = near_dup.jaccard_components(table(spark, ["a b", "A  b", "a b", None, ""], [7, None, 7, 3, 3])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == [("3", 0, 3), ("3", 0, 3), ("7", 1, 7), ("7", 1, 7), ("None", 1, 7)]
    assert near_dup.keep_one(table(spark, ["a b", "A  b", "a b"], [7, None, 7])).count() == 1
    assert near_dup.jaccard_components(table(spark, ["x"]).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- sharding


def test_many_shards(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"))
    rows = sharding.histogram_shards(df, 1500, parts_per_shard=1).groupBy("shard").count().collect()
    assert len(rows) == 1500 and max(r["count"] for r in rows) <= 5


def test_histogram_shards(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(8, 400) for _ in range(900)]
    ids = [rng.choice([7, 7, -5, rng.randrange(10**12), -(10**15), None]) for _ in sizes]  # hot and equal values
    df = spark.createDataFrame(list(zip(ids, sizes)), "doc_id long, size long").withColumn("shard", F.lit(-1)).repartition(3)
    rows = sharding.histogram_shards(df, 24).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert len(rows) == len(sizes) and sorted(by) == list(range(24))
    for shard, held in by.items():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - sum(sizes) / 24) <= 400 + 1
    low = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
    along = [low(r) for k in range(24) for r in sorted(by[k], key=lambda r: r.slot)]
    assert along == sorted(along)
    own = df.withColumns({c: F.lit(c) for c in ("rank_in_part", "before_part", "before", "at", "part", "hi", "low")})
    kept = sharding.histogram_shards(own, 24)
    assert kept.count() == len(sizes) and kept.select("rank_in_part", "before_part", "before", "at", "part", "hi", "low").distinct().collect() == [("rank_in_part", "before_part", "before", "at", "part", "hi", "low")]
    assert sharding.histogram_shards(df.limit(0), 24).count() == 0
    assert sorted(r.slot for r in sharding.histogram_shards(df.limit(1), 24).collect()) == [0]


# --- language models


def sentences(rng, nouns, n):
    return [" ".join(f"the {rng.choice(nouns)} of a {rng.choice(nouns)} is" for _ in range(rng.randrange(8, 30))) + "." for _ in range(n)]


def test_quality_classifier(spark):
    rng = random.Random(11)
    good = sentences(rng, ["house", "tree", "river", "garden"], 150)
    junk = ["Zqx Zqx Zqx Zqx " * 20, "BUY!! NOW!! $$$ " * 20, "| 77 | x%% | " * 30] * 5
    odd = [None, "", "the", LONG]
    texts = good + junk + odd
    docs = table(spark, texts, lang=F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise("en"), loss=F.lit(1)).repartition(2)
    labels = spark.createDataFrame([(i, True) for i in range(120)] + [(0, True), (None, True), (151, False)], "doc_id long, trusted boolean")
    options = {"least": 10, "quantile": 1.0}
    got = {r.doc_id: r for r in quality.classify(common.placed(docs), labels, **options).collect()}
    assert len(got) == len(texts)
    assert sum(got[i].kept for i in range(150)) >= 145
    assert not any(got[i].kept for i in range(150, 165))
    assert got[165].perplexity is None and got[165].kept and got[166].kept
    kept = quality.keep_good(docs, labels, **options)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.classify(common.placed(docs.limit(0)), labels).count() == 0
    assert quality.classify(common.placed(docs), labels.limit(0)).filter("NOT kept").count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = sentences(random.Random(2), ["cat", "dog"], 30)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), min_count=1)
    kinds = (quality.FIRST_WORD + len(model.vocabulary)) * quality.FORMS
    w = np.arange(kinds, dtype=np.int64)
    numbers = quality.numbering(model.vocabulary)
    the = int(quality.tokens_of(numbers, b"the")[0])
    for u, v in ((1, 1), (1, the), (the, the)):
        p = np.exp(-model.losses(np.full(kinds, u), np.full(kinds, v), w))
        assert abs(p.sum() - 1) < 1e-6


def test_cross_entropy_difference(spark):
    rng = random.Random(4)
    law, food = sentences(rng, ["court", "judge", "law"], 60), sentences(rng, ["bread", "soup", "salt"], 60)
    texts = law + food + [None, "", LONG]
    docs = table(spark, texts, target=F.lit(1), n_tokens=F.lit(2)).repartition(2)
    target = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (0,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, target).collect()}
    held_out = [got[i].score for i in range(30, 60)]
    assert max(held_out) < min(got[i].score for i in range(60, 120))
    assert got[120].score is None and got[120].n_tokens == 0 and got[122].n_tokens == len(words(LONG))
    assert lm_score.cross_entropy_difference(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("leaf", [2, 10, 1000])
def test_partners_within_a_region(leaf):
    rng = np.random.default_rng(leaf)
    bases = [rng.choice(10**6, size=40, replace=False) for _ in range(6)]
    sets = []
    for _ in range(150):
        x = bases[rng.integers(6)].copy()
        k = rng.integers(0, 16)
        x[:k] = rng.integers(0, 10**6, size=k)
        sets.append(np.unique(x).astype(np.uint64))
    sizes = np.array([len(x) + rng.integers(0, 4) for x in sets])
    region = regions.Region(sets, sizes, 75, leaf)
    for x, n in zip(sets, sizes):
        shared = np.array([len(set(x.tolist()) & set(y.tolist())) for y in sets])
        assert sorted(region.partners(x, int(n)).tolist()) == np.flatnonzero(100 * shared >= 75 * (sizes + n - shared)).tolist()


@pytest.mark.parametrize("keep", [near_dup.keep_one, exact_dedup.keep_first])
def test_columns_named_like_inner_ones(spark, keep):
    docs = table(spark, ["a b", "a b", "c"], **{c: F.lit(c) for c in ("place", "node", "digest", "_place", "row", "n")})
    kept = keep(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(i, t, "place", "node", "digest", "_place", "row", "n") for i, t in ((0, "a b"), (2, "c"))}
