"""The pipeline, stage by stage and as a whole, against plain Python; and the quality model against a plain one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveframe.llm import common, packing, quality, tokens

from test_operators import LONG, brute_components, brute_hits, crc, ids_of, sentences, table

COLUMNS = "doc_id long, text string, lang string, place string"


def plain_model(texts, min_count):
    """-log P of the tokens of a text under an interpolated modified Kneser-Ney model, counted with dictionaries."""
    words = Counter(quality.core_of(w) for t in texts for w in t.encode().split())
    kept = sorted((-n, w) for w, n in words.items() if n >= min_count and w)
    vocabulary = {w: i for i, (_, w) in enumerate(kept)}
    numbers = quality.numbering(vocabulary)

    def events(text):
        u = v = quality.START
        for w in quality.tokens_of(numbers, text.encode()).tolist():
            yield u, v, w
            u, v = (v, w) if w >= quality.FORMS else (quality.START, quality.START)
            u = u if u >= quality.FORMS else quality.START

    three = Counter(e for t in texts for e in events(t))
    two = Counter((v, w) for _, v, w in three)
    one = Counter((w,) for _, w in two)
    tables = []
    for counts in (three, two, one):
        d = quality.discounts(Counter(counts.values()))
        total, parts, left = Counter(), {}, {}
        for key, n in counts.items():
            total[key[:-1]] += n
        for key, n in counts.items():
            parts[key] = (n - d[min(n, 3) - 1]) / total[key[:-1]]
            left[key[:-1]] = left.get(key[:-1], 1.0) - parts[key]
        tables.append((parts, left))
    kinds = (quality.FIRST_WORD + len(vocabulary)) * quality.FORMS

    def loss(text):
        out = []
        for u, v, w in events(text):
            p = 1 / kinds
            for (parts, left), key in zip(reversed(tables), ((w,), (v, w), (u, v, w))):
                p = parts.get(key, 0.0) + left.get(key[:-1], 1.0) * p
            out.append(-math.log(p))
        return out

    return loss


def odd_sentences(rng, n):
    vocabulary = ["house", "tree", "river", "garden", "Straße", "12.5", "x-ray", "END"]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "!!"]) for _ in range(rng.randrange(3, 25))) for _ in range(n)]


def test_perplexity_is_that_of_a_plain_model(spark):
    rng = random.Random(21)
    texts = odd_sentences(rng, 30) + ["the the the the the end", "house house tree", "unknown words here, and häuser"]
    docs = table(spark, [*texts, None, "", LONG[:3000]], lang=F.lit("en"))
    loss = plain_model(texts, 2)
    model = quality.train(docs.filter(f"doc_id < {len(texts)}").select("text"), min_count=2)
    got = {r.doc_id: r for r in quality.score(common.placed(docs), model).collect()}
    for n, text in enumerate([*texts, "", "", LONG[:3000]]):
        expected = loss(text)
        assert got[n].n_tokens == len(expected) and got[n].loss == pytest.approx(sum(expected), rel=1e-9)


def test_default_classification_by_hand(spark):
    rng = random.Random(22)
    say = {"en": ["house", "tree", "river"], "de": ["Haus", "Baum", "Fluss"], "fr": ["maison", "arbre"]}
    texts, langs = [], []
    for lang, nouns in say.items():
        texts += sentences(rng, nouns, 60)
        langs += [lang] * 60
    texts += ["Zqx Qzx Xzq " * 30, "BUY!! NOW!! $$$ " * 20]
    langs += ["en", "de"]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, True) for i in range(180)], "doc_id long, trusted boolean")
    rows = {r.doc_id: r for r in quality.classify(common.placed(docs), labels).collect()}
    aside = {r.doc_id for r in docs.filter("doc_id < 180 AND pmod(xxhash64(doc_id), 1000) < 300").collect()}
    loss = plain_model([texts[i] for i in range(180) if i not in aside], 4)
    losses = {i: loss(t) for i, t in enumerate(texts)}
    for i, r in rows.items():
        own = [j for j in aside if langs[j] == langs[i]]
        mean = sum(sum(losses[j]) for j in own) / sum(len(losses[j]) for j in own)
        score = {j: (sum(losses[j]) + 30 * mean) / (len(losses[j]) + 30) for j in [*own, i]}
        assert r.perplexity == pytest.approx(math.exp(sum(losses[i]) / len(losses[i])), rel=1e-9)
        assert r.score == pytest.approx(score[i], rel=1e-9) and r.threshold == pytest.approx(max(score[j] for j in own), rel=1e-9)
        assert r.kept == (r.score <= r.threshold)
    assert len({r.threshold for r in rows.values()}) == 3 and not rows[180].kept and not rows[181].kept


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, junk, passages of a benchmark, odd texts; and the tables beside them."""
    rng = random.Random(31)
    folder = str(tmp_path_factory.mktemp("corpus"))
    good = sentences(rng, ["house", "tree", "river", "garden", "road"], 90)
    passage = " ".join(good[42].split()[3:40])
    texts = list(good)
    texts += ["Zqx Qxz Zxq Qzz " * 25, "BUY!! NOW!! $$$ " * 25]  # junk
    texts += [good[3], good[3].replace(" ", "  "), good[7]]  # copies
    for k, n in ((10, 25), (11, 31), (10, 31)):  # near copies: another noun in one place
        copy = good[k].split()
        copy[n] = "tree" if copy[n] != "tree" else "road"
        texts.append(" ".join(copy))
    texts += [f"the house is {passage[: rng.choice([60, 200])]}" for _ in range(3)]
    texts += [None, "", "  ", None, "the", "the house of a tree " * 700]
    rows = [(i if i != 5 else None, t, rng.choice(["en", None]), "p") for i, t in enumerate(texts)]
    rows.append((20, texts[20], "en", "p"))  # a repeated row
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(len(texts))] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "...")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def smallest(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_every_stage(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        kept.append((plain_rows(before), plain_rows(docs)))
        if number < 4:
            assert docs.columns == before.columns
    # 1: the classifier's own decisions, row by row
    from sieveframe.llm.queries import trusted_labels

    first = spark.read.parquet(f"{corpus}/documents.parquet")
    decided = quality.classify(common.placed(first), trusted_labels(spark, corpus)).groupBy("doc_id").agg(F.count_if("kept").alias("n")).collect()
    assert {r.doc_id: r.n for r in decided if r.n} == dict(Counter(r[0] for r in kept[0][1])) and len(kept[0][1]) < len(kept[0][0])
    assert not {90, 91} & {r[0] for r in kept[0][1]}
    # 2: one row for each normalised text, the one with the smallest id
    groups = defaultdict(list)
    for r in kept[1][0]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    assert sorted(r[0] if r[0] is not None else -1 for r in kept[1][1]) == sorted(x if (x := smallest(g)[0]) is not None else -1 for g in groups.values())
    # 3: one of each component
    rows = kept[2][0]
    classes = defaultdict(list)
    for i, (_, root) in brute_components([r[1] for r in rows]).items():
        classes[root].append(rows[i])
    assert sorted(map(repr, kept[2][1])) == sorted(repr(smallest(g)) for g in classes.values()) and len(kept[2][1]) < len(rows)
    # 4: not those with benchmark words
    items = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = []
    for r in kept[3][0]:
        w, hit, _ = brute_hits(r[1], items)
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    assert kept[3][1] == clean and len(clean) < len(kept[3][0])
    # 5: every id once, in pieces of powers of two
    check_pieces(clean, docs.collect())


def check_pieces(rows, pieces):
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert {r[0] for r in rows} == set(by)
    for doc_id, text, *_ in rows:
        ids = ids_of("byte_bpe_50k.json", text, 1)
        own = sorted(by[doc_id], key=lambda p: p.start)
        assert [p.length for p in own] == packing.decompose(len(ids)) and [x for p in own for x in p.ids] == ids
        assert all(p.ids_crc32 == crc(p.ids) for p in own)
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))


def test_the_whole_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        path = common.scratch_path(spark, "by-hand")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    check_pieces([tuple(r) for r in docs.collect()], corpus_pipeline.run(spark, corpus).collect())


def test_empty_tables(spark, tmp_path):
    for name, form in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], form).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(stage(spark, docs, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_public_files_are_where_the_parameter_says():
    assert np.array(tokens.encoder(tokens.public_path("byte_bpe_50k.json"))._plain_ids("a")).size == 1
