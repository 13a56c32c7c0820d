"""Nothing of the input is left out: models, thresholds and rules against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveframe.llm import common, lm_score, quality, url_rules

from test_operators import table, words
from test_pipeline import plain_model


def brute_losses(texts, chosen):
    """Mean -log P of each text's events under the bigram model of the chosen texts; no count is left out."""
    pairs = [list(zip(["<", *words(t)], [*words(t), ">"])) if words(t) else [] for t in texts]
    vocabulary = {w for x in pairs for _, w in x}  # with the end
    mine = Counter(p for i in chosen for p in pairs[i])
    after = Counter(v for i in chosen for v, _ in pairs[i])

    def loss(v, w):
        return -math.log((mine[v, w] or 1 / len(vocabulary)) / (after[v] + 1))

    return [sum(loss(*p) for p in x) / len(x) if x else None for x in pairs]


@pytest.mark.parametrize("chunk, often", [(50, 2), (200, 5), (lm_score.CHUNK, lm_score.OFTEN)])
def test_every_word_and_bigram_is_in_the_models(spark, chunk, often):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", None]
    chosen = range(20)
    ids = [*range(60), None, 7]  # a null id, and an id of two rows
    docs = table(spark, texts, ids).repartition(3)
    target = spark.createDataFrame([(i,) for i in chosen] + [(None,), (3,)], "doc_id long")
    got = {(r.doc_id, r.n_tokens): r for r in lm_score.cross_entropy_difference(docs, target, chunk=chunk, often=often).collect()}
    assert len(got) == len(texts)
    for i, n, t, b in zip(ids, (len(words(x)) for x in texts), brute_losses(texts, chosen), brute_losses(texts, range(len(texts)))):
        assert got[i, n].target_loss == (t if t is None else pytest.approx(t, abs=1e-6))
        assert got[i, n].background_loss == (b if b is None else pytest.approx(b, abs=1e-6))


def test_every_target_document_is_counted(spark):
    docs = table(spark, [f"w{i}" for i in range(20_050)])
    scores = lm_score.cross_entropy_difference(docs, docs.select("doc_id"))
    assert scores.count() == 20_050 and scores.filter("score <> 0").count() == 0


def test_ngrams_met_once_are_in_the_quality_model(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(25)) for _ in range(40)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), min_count=1)
    numbers = quality.numbering(model.vocabulary)
    u, v, w = quality._contexts([quality.tokens_of(numbers, t.encode()) for t in texts])
    for keys, found in ((u << 2 * quality.BITS | v << quality.BITS | w, model.three[0]), (v << quality.BITS | w, model.two[0])):
        kinds, n = np.unique(keys, return_counts=True)
        assert (n == 1).any() and np.array_equal(kinds, found)


def test_small_languages_have_their_own_threshold(spark):
    rng = random.Random(6)
    say = lambda nouns, n: [" ".join(f"the {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(12)) for _ in range(n)]
    texts = say(["house", "tree"], 200) + say([f"wort{i}" for i in range(200)], 40) + say(["casa", "rio"], 5)
    docs = table(spark, texts, lang=F.when(F.col("doc_id") < 200, "en").when(F.col("doc_id") < 240, "de").otherwise("es"))
    labels = spark.createDataFrame([(i, True) for i in range(240)], "doc_id long, trusted boolean")
    got = quality.classify(common.placed(docs), labels).collect()
    aside = {r.doc_id for r in docs.filter("doc_id < 240 AND pmod(xxhash64(doc_id), 1000) < 300").collect()}
    most = {x: max(r.score for r in got if r.doc_id in aside and r.lang == x) for x in ("en", "de")}
    assert {(r.lang, r.threshold) for r in got if r.lang != "es"} == set(most.items())
    assert len({r.threshold for r in got if r.lang == "es"}) == 1


def test_rare_hosts_and_long_sets_become_rules(spark):
    # Two of 1,006 bad pages in a hundred are more than any rare host has; the five words are bad only together.
    bad = [f"http://h{chr(97 + i // 26)}{chr(97 + i % 26)}.example.net/x" for i in range(100) for _ in range(10)] + ["http://s.example.net/a/b/c/d/e"] * 6
    fine = ["http://s.example.net/" + "/".join(x for x in "abcde" if x != y) for y in "abcde" for _ in range(20)] + ["http://other.example.net/x"] * 400
    urls = bad + fine
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i < len(bad)) for i in range(len(urls))], "page_id long, bad boolean")
    rows = url_rules.judge_urls(pages, [("allow", "nowhere.example", "/")], labels).collect()
    assert all((r.verdict == "block") == (r.page_id < len(bad)) for r in rows)


def test_numbers_of_many_texts(monkeypatch):
    from sieveframe.llm import ngrams

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bb", "é", "\xa0", " ", "  ", "\t", "\n", "\x0b", "\x1c", "C"]) for _ in range(rng.randrange(40))).encode() for _ in range(300)]
    for piece, keep in ((4 << 20, 5), (7, 100_000)):
        monkeypatch.setattr(ngrams, "PIECE", piece)
        seen: list[bytes] = []
        numbers = ngrams.Numbers(lambda w: seen.append(w) or sum(w) * 31 + len(w), keep=keep)
        for at in range(0, 300, 50):
            some = [b"", *texts[at : at + 50], b" ", b"a "]
            got = numbers.of_all(some, common.LOWER_BYTES)
            assert [x.tolist() for x in got] == [[sum(w) * 31 + len(w) for w in t.translate(common.LOWER_BYTES).split()] for t in some]
        assert keep == 5 or len(seen) == len(set(seen))
    assert numbers.of_all([]) == [] and numbers.of(b"").tolist() == []


def test_every_trusted_text_trains_the_quality_model(spark):
    rng = random.Random(15)
    texts = [f"w{i} of w{i} w{rng.randrange(60)} w{i} is w{i}" for i in range(7_500)]  # some 5,250 of them for training
    docs = table(spark, texts, lang=F.lit("en"))
    got = {r.doc_id: r.perplexity for r in quality.classify(common.placed(docs), docs.select("doc_id", F.lit(True).alias("trusted"))).collect()}
    aside = {r.doc_id for r in docs.filter("pmod(xxhash64(doc_id), 1000) < 300").collect()}
    assert len(texts) - len(aside) > 5_000
    loss = plain_model([t for i, t in enumerate(texts) if i not in aside], 4)
    for i, t in enumerate(texts):
        expected = loss(t)
        assert got[i] == pytest.approx(math.exp(sum(expected) / len(expected)), rel=1e-9)


def test_the_quality_model_knows_every_word(spark):
    texts = [" ".join(f"w{i + k}" for i in range(5_000) for _ in range(2)) for k in range(0, 50_000, 5_000)] * 2
    assert len(quality.train(spark.createDataFrame([(t,) for t in texts], "text string")).vocabulary) == 50_000


@pytest.mark.parametrize("chunk, rounds", [(1, 1), (60, 3)])
def test_chunks_and_rounds_leave_the_perplexity_as_it_is(spark, chunk, rounds):
    rng = random.Random(16)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    docs = table(spark, [*texts, None, ""], lang=F.lit("en")).repartition(3)
    loss = plain_model(texts[:60], 2)
    model = quality.train(docs.filter("doc_id < 60").select("text"), min_count=2, chunk=chunk)
    got = {r.doc_id: r for r in quality.score(common.placed(docs), model, chunk=chunk, rounds=rounds).collect()}
    assert len(got) == len(texts) + 2 and got[80].loss == got[81].loss == got[80].n_tokens == 0
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(loss(t)) and got[i].loss == pytest.approx(sum(loss(t)), rel=1e-9)


@pytest.mark.parametrize("bits", [21, 31])
def test_wide_tokens_are_sorted_like_narrow_ones(bits):
    u, v, w = np.random.default_rng(1).integers(0, 40, (3, 5_000)) << (bits - 7)
    order, first, pair, mine = quality._sorted(u, v, w, bits)
    n = np.diff(np.append(first, len(order)))
    back = ((pair >> bits) * pow(quality.ODD, -1, 1 << bits)) & ((1 << bits) - 1)
    found = dict(zip(zip(mine.tolist(), back.tolist(), (pair & ((1 << bits) - 1)).tolist()), n.tolist()))
    assert found == Counter(zip(u.tolist(), v.tolist(), w.tolist())) and (np.diff(pair) >= 0).all()


def test_thresholds_are_exact_quantiles(spark):
    rng = random.Random(17)
    scores = {"en": [rng.random() for _ in range(60_000)], "de": [rng.random() for _ in range(501)], "fr": [0.5]}
    rated = spark.createDataFrame([(g, x) for g, xs in scores.items() for x in xs], "lang string, score double")
    at = lambda xs: sorted(xs)[math.ceil(round(len(xs) * 0.998, 6)) - 1]
    assert {r.lang: r.own for r in quality._quantile(rated, 0.998, "lang").collect()} == {g: at(xs) for g, xs in scores.items()}
    assert [r.own for r in quality._quantile(rated, 0.998).collect()] == [at([x for xs in scores.values() for x in xs])]
