"""Benchmark decontamination with one Aho-Corasick automaton over all windows of the benchmark's words.

Texts are folded to words (A-Z lower-cased, see common.WORD_BYTES) and joined by single spaces. The folding replaces
bytes one by one, so a word's place in the folded text leads back to its bytes in the original. Each document is
scanned once, from end to end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTES, byte_values, held, trim, without

WORD = re.compile(rb"[^ ]+")
#: A benchmark of more bytes than this is scanned for shard by shard; every shard's automaton fits a worker.
SHARD_BYTES = 8 << 20

#: n_words; the runs of words that lie inside occurrences (first word, word after the last; apart, in order), the bytes
#: of the original text they stand in, and the ids of the items with occurring windows, sorted.
HITS = "place string, doc_id long, n_words long, starts array<long>, ends array<long>, from_byte array<long>, to_byte array<long>, items array<string>"


def fold(text: bytes) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join(text.translate(WORD_BYTES).split())


def windows(text: bytes, size: int = 13) -> list[bytes]:
    """All runs of ``size`` consecutive words, folded; the whole of a text of fewer words, nothing of one of none."""
    words = text.translate(WORD_BYTES).split()
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(items: list[tuple[str, bytes]], size: int):
    """The automaton of all windows of the items; a window's value is (its words, the ids of its items)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():  # spaces at both ends: words match as a whole
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(automaton, folded: bytes) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, word after the last, item ids) of every occurrence of a window, in order of its end."""
    found, words, at = [], 0, 0
    if len(automaton) and folded:
        for end, (size, ids) in automaton.iter(f" {folded.decode('latin-1')} "):
            words += folded.count(b" ", at, end)  # end: the space after the window, in the text with a space in front
            at = max(at, end)
            last = words + (end >= len(folded))
            found.append((last - size, last, ids))
    return found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words that the spans cover together, apart and in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _row(text: bytes, n_words: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    spans = united(spans)
    places = original_spans(text, [a for a, _ in spans], [b for _, b in spans]) if spans else []
    return n_words, [a for a, _ in spans], [b for _, b in spans], [a for a, _ in places], [b for _, b in places], items


def _batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    longs, names = pa.list_(pa.int64()), ["n_words", "starts", "ends", "from_byte", "to_byte", "items"]
    kinds = [pa.int64(), longs, longs, longs, longs, pa.list_(pa.string())]
    columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), *columns], names=["place", "doc_id", *names])


def _search(shared, key: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(f"automaton {key}", lambda: build(shared.value, size))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for text in byte_values(batch.column("text")):
                    folded = fold(text)
                    found = scan(automaton, folded)
                    # Windows share their tuple of items, so each tuple is looked into once.
                    items = sorted({item for ids in {id(x[2]): x[2] for x in found}.values() for item in ids})
                    rows.append(_row(text, (folded.count(b" ") + 1) if folded else 0, [x[:2] for x in found], items))
                yield _batch(batch, rows)
        trim()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose runs come from several automata, with those that meet as one."""
    for batch in batches:
        rows = []
        for n, *runs, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends", "from_byte", "to_byte", "items"))):
            bytes_of = dict(zip(runs[0], runs[2])), dict(zip(runs[1], runs[3]))
            spans = united(list(zip(runs[0], runs[1])))
            rows.append((n, [a for a, _ in spans], [b for _, b in spans], [bytes_of[0][a] for a, _ in spans], [bytes_of[1][b] for _, b in spans], sorted(set(items))))
        yield _batch(batch, rows)


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs`` (from placed()), with the columns of HITS.

    A benchmark of up to ``shard_bytes`` (its bytes are counted first) is one shard with one automaton.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    weight = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-weight // shard_bytes))
    read = docs.select("place", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(shards):
        part = known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast([(x.item, x.text.encode()) for x in part.toLocalIterator()])
        one = read.mapInArrow(_search(shared, shared._jbroadcast.id() if shared._jbroadcast else id(shared), size), HITS)
        found = one if found is None else found.unionByName(one)
    if shards == 1:
        return found
    runs = ("starts", "ends", "from_byte", "to_byte", "items")
    together = found.groupBy("place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in runs)
    )
    return together.mapInArrow(_merged, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, **options) -> DataFrame:
    """One row per row of ``docs`` (from placed()): place, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Reads doc_id and text of ``docs``, item_id and text of ``benchmark``, ignores further columns. A document is
    contaminated when some word lies inside a window of ``size`` benchmark words and such words are at least one in
    ``share``. ``spans`` are the bytes of the original UTF-8 text (from, to) in which such words stand, run by run.
    Null and empty texts have no words; items without words have no windows; a null item id counts as the empty string;
    repeated rows keep a row each; empty tables give an empty result or no hits.
    """
    hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return (
        find_windows(docs, benchmark, size, **options)
        .select(
            "place",
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            F.arrays_zip(F.col("from_byte").alias("from"), F.col("to_byte").alias("to")).alias("spans"),
        )
        .withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows; all its columns as they are."""
    return without(docs, lambda located: decontaminate(located, benchmark, **options).filter("contaminated"), "contaminated")


def original_spans(text: bytes, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Byte offsets in the original UTF-8 text of runs of words (first word, word after the last)."""
    places = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    return [(places[a][0], places[b - 1][1]) for a, b in zip(starts, ends)]
