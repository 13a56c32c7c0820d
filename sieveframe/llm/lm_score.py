"""Cross-entropy difference of two matched n-gram models.

Target and background model are bigram models over one vocabulary, estimated alike: with n(v) events after the word v,
a word that followed it n(v, w) times has the probability n(v, w) / (n(v) + ESCAPE), and any other ESCAPE / (n(v) +
ESCAPE), spread evenly over the vocabulary. Beginnings count as a word before the first, ends as one after the last. The
background counts come from every document, the target counts from every document named as target; every word and
every bigram that occurs is in the models, however rare it is and however large the corpus.

An event's loss is a sum of a term for the bigram and one for its context, each a function of one total. So bigrams and
contexts are features alike: those of a chunk of documents are sorted once and dealt by their hash, totals are taken
where equal features meet, and what comes back to the chunk is each document's sum over the features of that bucket.
Features that are frequent within a chunk are counted there, and only their totals travel; so no feature, however
frequent, gathers its occurrences in one task. No table of the models is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blobs import mix, numbers, of_planes, planes, rows, run_starts, spread
from .common import WORD_BYTES, materialise, text_or_empty, tidy, trim
from .ngrams import Numbers, slices

ESCAPE = 1.0
#: Words and documents of a chunk; a chunk ends with the document that reaches either.
CHUNK, CHUNK_DOCS = 500_000, 60_000
#: A feature of so many occurrences in a chunk is counted there.
OFTEN = 16
#: Bits of the filter that tells most documents which are no target from the others, whatever the number of targets.
FILTER_BITS = 1 << 26
#: Losses are summed as integers in this unit, so that sums do not depend on their order.
UNIT = 2.0**-28
BEGIN, END = 1, 2
ODD = np.uint64(0x9E3779B97F4A7C15)

DOCUMENT, PART, SIDE, SUM, FOUND, VOCABULARY = range(6)
TYPES = {"kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "seq": pa.int32(), "doc_id": pa.int64(), "n": pa.int64()}
TYPES |= {c: pa.binary() for c in "abcdefg"}
ROW = "kind int, bucket int, chunk long, seq int, doc_id long, n long, " + ", ".join(f"{c} binary" for c in "abcdefg")
RESULT = "kind int, doc_id long, n long, t long, b long, unseen long"


def _hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word) - (1 << 63)


def _features(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of the documents' events, and the documents' numbers: contexts are even, bigrams odd."""
    events = np.array([len(x) + 1 if len(x) else 0 for x in words], dtype=np.int64)
    begin, end = np.array([BEGIN], dtype=np.uint64), np.array([END], dtype=np.uint64)
    v = np.concatenate([np.zeros(0, dtype=np.uint64), *(part for x in words if len(x) for part in (begin, x))])
    w = np.concatenate([np.zeros(0, dtype=np.uint64), *(part for x in words if len(x) for part in (x, end))])
    owner = np.repeat(np.arange(len(words), dtype=np.uint16), events)
    return np.concatenate([_contexts(v), mix(v * ODD + mix(w)) | np.uint64(1)]), np.concatenate([owner, owner])


def _contexts(v: np.ndarray) -> np.ndarray:
    return mix(v) & ~np.uint64(1)


def _deal(buckets: int, chunk_words: int, often_from: int, number: int):
    """A row per document (doc_id, text, target), and the features of every chunk, dealt by hash into ``buckets``."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], dtype=np.uint64)

    def dealt(chunk: int, words: list[np.ndarray], target: list[bool]) -> Iterator[pa.RecordBatch]:
        flat, owner = _features(words)
        order = np.argsort(flat, kind="stable")  # owners in order too, which compresses better
        flat, owner = flat[order], owner[order]
        first = run_starts(flat)
        counts = np.diff(np.append(first, len(flat))).astype("u4")
        is_target = np.array(target, dtype=bool)
        mine = np.add.reduceat(is_target[owner].astype(np.int64), first).astype("u4") if len(first) else counts
        many = counts >= often_from
        inside = np.repeat(many, counts)
        keys, times, often, totals, targets = flat[first[~many]], counts[~many], flat[first[many]], counts[many], mine[many]
        beside, owner = owner[inside], owner[~inside]
        places = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
        cut, often_cut = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (keys, often))
        spans = [(k, slice(cut[k], cut[k + 1]), slice(often_cut[k], often_cut[k + 1])) for k in range(buckets)]
        spans = [x for x in spans if x[1].start < x[1].stop or x[2].start < x[2].stop]
        flags = np.packbits(is_target).tobytes()
        yield rows(
            TYPES, len(spans), kind=[PART] * len(spans), bucket=[x[0] for x in spans], chunk=[chunk] * len(spans), n=[len(words)] * len(spans),
            a=[planes(keys[s]) for _, s, _ in spans], b=[planes(times[s]) for _, s, _ in spans],
            c=[planes(owner[places[s.start] : places[s.stop]]) for _, s, _ in spans],
            d=[planes(often[s]) for _, _, s in spans], e=[planes(totals[s]) for _, _, s in spans], f=[planes(targets[s]) for _, _, s in spans],
            g=[flags] * len(spans),
        )
        yield rows(TYPES, 1, kind=[SIDE], bucket=[spread(chunk, buckets)], chunk=[chunk], a=[planes(often)], b=[planes(totals)], c=[planes(beside)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers(_hash)
        chunk, words, target, size = (TaskContext.get().partitionId() << 25) + (number << 24), [], [], 0
        for batch, texts in slices(batches):
            chunks, seqs, ns = [], [], []
            for found, is_target in zip(known.of_all(texts, WORD_BYTES), batch.column("target").to_pylist()):
                found = found.view(np.uint64)
                chunks.append(chunk)
                seqs.append(len(words))
                ns.append(len(found))
                words.append(found)
                target.append(bool(is_target))
                size += len(found)
                if size >= chunk_words or len(words) >= CHUNK_DOCS:
                    yield from dealt(chunk, words, target)
                    chunk, words, target, size = chunk + 1, [], [], 0
            yield rows(
                TYPES, len(ns), kind=[DOCUMENT] * len(ns), bucket=[spread(x + k, buckets) for k, x in enumerate(chunks)],
                chunk=chunks, seq=seqs, doc_id=batch.column("doc_id"), n=ns,
            )
        if words:
            yield from dealt(chunk, words, target)
        trim()

    return run


def _losses(keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's term of the loss in UNITs, and whether it is a bigram that the model lacks."""
    bigram = (keys & np.uint64(1)).astype(bool)
    unseen = bigram & (total == 0)
    term = np.where(bigram, -np.log(np.maximum(total, 1)), np.log(total + ESCAPE))
    return np.rint(term / UNIT), unseen


def _sums(keys, n_b, n_t, times, owner, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every document of a chunk the sums over its occurrences of the features: t, b, unseen."""
    (t, unseen), (b, _) = _losses(keys, n_t), _losses(keys, n_b)
    return tuple(np.bincount(owner, weights=np.repeat(x.astype(np.float64), times), minlength=documents).astype(np.int64) for x in (t, b, unseen))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the features of each bucket, from rows in order of their bucket, and what they mean for each chunk."""
    bucket, parts = None, []
    for batch in batches:
        is_part = np.asarray(batch.column("kind")) == PART
        if not is_part.all():
            yield batch.filter(pa.array(~is_part))
        for row in batch.filter(pa.array(is_part)).to_pylist():
            if row["bucket"] != bucket:
                yield from _totals(parts)
                bucket, parts = row["bucket"], []
            flags = np.unpackbits(numbers(row["g"], "u1"), count=row["n"]).astype(bool)
            parts.append((row["chunk"], row["n"], of_planes(row["a"]), of_planes(row["b"], "u4"), of_planes(row["c"], "u2"), of_planes(row["d"]), of_planes(row["e"], "u4"), of_planes(row["f"], "u4"), flags))
    yield from _totals(parts)
    trim()


def _totals(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    inline_t = []
    for _, _, keys, times, owner, _, _, _, flags in parts:
        starts = np.cumsum(times, dtype=np.int64) - times
        inline_t.append(np.add.reduceat(flags[owner].astype(np.int64), starts) if len(keys) else np.zeros(0, dtype=np.int64))
    both = [p[2] for p in parts] + [p[5] for p in parts]
    flat = np.concatenate(both)
    n_b = np.concatenate([p[3] for p in parts] + [p[6] for p in parts]).astype(np.int64)
    n_t = np.concatenate(inline_t + [p[7].astype(np.int64) for p in parts])
    order = np.argsort(flat)
    ordered = flat[order]
    first = run_starts(ordered)
    which = np.empty(len(flat), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
    n_b, n_t = np.add.reduceat(n_b[order], first)[which], np.add.reduceat(n_t[order], first)[which]
    found = ordered[first]
    words = int(((found & np.uint64(1)) == 0).sum()) - int((found == _contexts(np.array([BEGIN], dtype=np.uint64))[0]).sum())
    yield rows(TYPES, 1, kind=[VOCABULARY], chunk=[-1], n=[words])
    ends = np.cumsum([len(x) for x in both])
    spans = [slice(e - len(x), e) for e, x in zip(ends, both)]
    for (chunk, documents, keys, times, owner, often, _, _, _), one, two in zip(parts, spans, spans[len(parts) :]):
        sums = _sums(keys, n_b[one], n_t[one], times, owner, documents)
        there = np.flatnonzero(np.bincount(owner, minlength=documents))
        yield rows(TYPES, 1, kind=[SUM], chunk=[chunk], a=[planes(there.astype("u2"))], b=[planes(sums[0][there])], c=[planes(sums[1][there])], d=[planes(sums[2][there].astype("u4"))])
        if len(often):
            yield rows(TYPES, 1, kind=[FOUND], chunk=[chunk], a=[planes(often)], b=[planes(n_b[two])], c=[planes(n_t[two])])


def _chunk(table: pa.Table) -> pa.Table:
    """The documents of a chunk with all their sums, or the size of the vocabulary."""
    kind = np.asarray(table.column("kind"))
    of = lambda k: table.filter(pa.array(kind == k))
    if VOCABULARY in kind:
        n = sum(of(VOCABULARY).column("n").to_pylist())
        return pa.table({"kind": pa.array([VOCABULARY], pa.int32())} | {c: pa.array([n if c == "n" else None], pa.int64()) for c in ("doc_id", "n", "t", "b", "unseen")})
    docs = of(DOCUMENT).select(["seq", "doc_id", "n"])
    count = docs.num_rows
    sums = [np.zeros(count, dtype=np.int64) for _ in range(3)]
    for x in of(SUM).to_pylist():
        owner = of_planes(x["a"], "u2")
        for total, own in zip(sums, (of_planes(x["b"], "i8"), of_planes(x["c"], "i8"), of_planes(x["d"], "u4"))):
            total[owner] += own
    found = of(FOUND).to_pylist()
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *(of_planes(x["a"]) for x in found)])
    order = np.argsort(keys)
    n_b, n_t = (np.concatenate([np.zeros(0, dtype=np.int64), *(of_planes(x[c], "i8") for x in found)])[order] for c in "bc")
    for x in of(SIDE).to_pylist():
        often = of_planes(x["a"])
        at = np.searchsorted(keys[order], often)
        for total, own in zip(sums, _sums(often, n_b[at], n_t[at], of_planes(x["b"], "u4"), of_planes(x["c"], "u2"), count)):
            total += own
    seq = docs.column("seq").to_numpy()
    return pa.table(
        {"kind": pa.array(np.full(count, DOCUMENT, dtype=np.int32)), "doc_id": docs.column("doc_id"), "n": docs.column("n")}
        | {c: pa.array(x[seq]) for c, x in zip(("t", "b", "unseen"), sums)}
    )


def _near_targets(ids: DataFrame) -> np.ndarray:
    """A bit for each hash class of the ids: FILTER_BITS, however many ids there are."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {FILTER_BITS}L), 64L) AS int))")
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for batch in ids.select(F.floor(at / 64).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        bits[batch.column("at").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return bits


@tidy
def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, chunk: int = CHUNK, often: int = OFTEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    The losses are -log P per event (each word, and the end), ``score`` is target_loss - background_loss: the lower, the
    more a document is like the target. ``target_ids`` (doc_id) names the target documents, all of which are counted.
    Null and empty texts have no words, null losses and a null score; null ids in ``target_ids`` are ignored; repeated
    rows keep a row each; further columns are ignored. ``chunk`` and ``often`` decide the cost, never the result.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.col("doc_id").cast("long")
    ids = materialise(target_ids.filter("doc_id IS NOT NULL").select(own.alias("doc_id")).distinct(), "lm-target")
    texts = docs.select(own.alias("doc_id"), text_or_empty().alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at"))
    bits = spark.sparkContext.broadcast(_near_targets(ids))  # FILTER_BITS bits

    def passing(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("at").to_numpy().astype(np.uint64)
                near = ((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                chosen = batch.filter(pa.array(near == wanted))
                if chosen.num_rows:
                    yield pa.RecordBatch.from_arrays([chosen.column("doc_id"), chosen.column("text"), pa.array(np.zeros(chosen.num_rows, dtype=bool))], names=["doc_id", "text", "target"])

        return run

    deal = [_deal(tasks, chunk, often, k) for k in (0, 1)]
    others = texts.mapInArrow(lambda batches: deal[0](passing(False)(batches)), ROW)
    near = texts.mapInArrow(passing(True), "doc_id long, text string, target boolean").drop("target")
    marked = near.join(ids.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left").select("doc_id", "text", "target")
    # In one order, so that a task that has to run again cuts the same chunks.
    marked = marked.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie").drop("tie")
    dealt = others.unionByName(marked.mapInArrow(deal[1], ROW)).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = materialise(dealt.mapInArrow(_summed, ROW).drop("bucket").groupBy("chunk").applyInArrow(_chunk, RESULT), "lm-losses")
    bits.destroy()

    words = found.filter(f"kind = {VOCABULARY}").agg(F.sum("n")).first()[0] or 0
    missing = float(np.log((words + 1) / ESCAPE))  # the end is an outcome too
    mean = lambda x: F.when(F.col("n") > 0, x / (F.col("n") + 1))
    return found.filter(f"kind = {DOCUMENT}").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        mean(F.col("t") * UNIT + F.col("unseen") * missing).alias("target_loss"),
        mean(F.col("b") * UNIT).alias("background_loss"),
    ).withColumn("score", F.col("target_loss") - F.col("background_loss"))
