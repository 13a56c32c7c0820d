"""Exact n-gram Jaccard join in the metric space of shingle sets, and its components.

Documents with equal shingle sets are one node. The join then goes from regions to links:

1. **Document frequencies.** The shingles of a chunk of documents are sorted once and dealt by their hash; equal ones
   are counted over all documents, and only shingles of two documents or more return to their chunk. What no other
   document has cannot be shared, so a document is left with its other shingles and the size of its whole set; it stands
   alone at once if fewer than 75 % are left.
2. **Pivots.** Two linked documents share one of their first few shingles in the order of frequency (the prefix bound:
   ``n - ceil(0.75 n) + 1`` of them, and ``n - ceil(6 n / 7) + 1`` for the smaller of the two). The most central document
   that has such a shingle, the one whose shingles are the most frequent, is a pivot for the others that have it.
3. **Voronoi regions.** A document goes to the pivot with which it shares most of these shingles, if they may be linked
   at all, and its exact distance to it is computed: within the threshold it is of the pivot's class. With all other
   pivots it shares fewer, so this is the nearest pivot as far as the prefix shows; pairs of documents at distance 1
   from each other, which are nearly all, are never looked at.
4. **Boundary windows.** A document is replicated to the region of another class with whose documents it shares a
   shingle within the prefix bound and whose sizes allow a link.
5. **Recursion.** A region is joined where it lies: large ones are split into Voronoi cells around pivots of their own,
   recursively, and a document visits the cells within the windows of the triangle inequality (regions.py). Regions of
   one class that nobody visits need no join.

Which pivot a document has decides the cost and never the result, so the regions of very many documents are dealt into
parts. Nothing is sampled, no region is capped and no list of pairs is made. Shingles are told apart by 64-bit hashes,
whole sets by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blobs import mix, numbers, of_planes, planes, rows, run_starts, spread
from .common import LOWER_BYTES, byte_values, forget, held, materialise, placed, tidy, trim, without
from .graph import components
from .ngrams import Numbers
from .regions import LEAF, Region, shared_with

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles and documents of a chunk; a chunk ends with the document that reaches either.
CHUNK, CHUNK_DOCS = 1_000_000, 60_000
#: A shingle of so many documents of a chunk is counted there, and its documents stay with the chunk.
OFTEN = 8
#: Documents of a region before it is dealt into parts.
CROWD = 20_000

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)
#: Kinds of rows on the way through the first exchange.
DOCUMENT, PART, FOUND, SIDE = range(4)
ROW = "kind int, bucket int, chunk long, seq int, doc_id long, place string, hi long, lo long, n long, a binary, b binary, c binary, d binary, e binary"
ROW_TYPES = {"kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "seq": pa.int32(), "doc_id": pa.int64(), "place": pa.string()}
ROW_TYPES |= {c: pa.int64() for c in ("hi", "lo", "n")} | {c: pa.binary() for c in "abcde"}


def _hashes() -> Numbers:
    from xxhash import xxh3_64_intdigest

    return Numbers(xxh3_64_intdigest, kind=np.uint64)


def shingle_set(ids: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of words with these hashes; fewer words make one shingle, none none."""
    n = len(ids)
    if n == 0:
        return ids
    size = min(n, size)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += ids[k : n - size + 1 + k] * _MULTIPLIERS[k % 5]
    found = mix(total)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for the set, as two signed integers."""
    return tuple(int(mix(shingles * _MULTIPLIERS[k] + _MULTIPLIERS[k + 2]).sum(dtype=np.uint64).astype(np.int64)) for k in (0, 1))


def least_shared(n):
    """The fewest shingles that a set of n shares with any partner."""
    return -(-PERCENT * n // 100)


def least_shared_with_larger(n):
    """The fewest shingles that a set of n shares with a partner that is not smaller."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def _describe(buckets: int, most: int, often_from: int):
    """A row per document, and the shingles of every chunk, dealt by hash into ``buckets``."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], dtype=np.uint64)

    def dealt(chunk: int, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(sets)
        order = np.argsort(flat)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])[order]
        flat = flat[order]
        first = run_starts(flat)
        counts = np.diff(np.append(first, len(flat)))
        many = counts >= often_from
        often, times = flat[first[many]], counts[many].astype("<u4")
        inline = np.repeat(~many, counts)
        flat, beside, owner = flat[inline], owner[~inline], owner[inline]
        cut, often_cut = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (flat, often))
        spans = [(k, cut[k], cut[k + 1], often_cut[k], often_cut[k + 1]) for k in range(buckets)]
        spans = [x for x in spans if x[1] < x[2] or x[3] < x[4]]
        yield rows(
            ROW_TYPES, len(spans), kind=[PART] * len(spans), bucket=[x[0] for x in spans], chunk=[chunk] * len(spans),
            a=[planes(flat[i:j]) for _, i, j, _, _ in spans], b=[owner[i:j].astype("<u2").tobytes() for _, i, j, _, _ in spans],
            d=[planes(often[i:j]) for _, _, _, i, j in spans], e=[times[i:j].tobytes() for _, _, _, i, j in spans],
        )
        if len(often):
            yield rows(ROW_TYPES, 1, kind=[SIDE], bucket=[spread(chunk, buckets)], chunk=[chunk], a=[planes(often)], b=[beside.astype("<u2").tobytes()], c=[times.tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk, sets, known, size = held("near-words", _hashes), TaskContext.get().partitionId() << 24, [], {}, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                chunks, seqs, names, ns = [], [], [], []
                # Words are [^\x20\x09-\x0D]+ after A-Z are lower-cased.
                for ids in words.of_all(byte_values(batch.column("text")), LOWER_BYTES):
                    shingles = shingle_set(ids)
                    name = signature(shingles) if len(shingles) else (None, None)
                    if len(shingles) and name not in known:
                        known[name] = len(sets)
                        sets.append(shingles)
                        size += len(shingles)
                    chunks.append(chunk)
                    seqs.append(known.get(name))
                    names.append(name)
                    ns.append(len(shingles))
                    if size >= most or len(sets) >= CHUNK_DOCS:
                        yield from dealt(chunk, sets)
                        chunk, sets, known, size = chunk + 1, [], {}, 0
                yield rows(
                    ROW_TYPES, len(ns), kind=[DOCUMENT] * len(ns), bucket=[spread(x + k, buckets) for k, x in enumerate(chunks)], chunk=chunks, seq=seqs, n=ns,
                    doc_id=batch.column("doc_id"), place=batch.column("place"), hi=[x[0] for x in names], lo=[x[1] for x in names],
                )
        if sets:
            yield from dealt(chunk, sets)
        trim()

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the shingles of each bucket over all chunks, from rows in order of their bucket.

    Every chunk gets back those of two documents or more.
    """
    bucket, parts = None, []
    for batch in batches:
        is_part = np.asarray(batch.column("kind")) == PART
        if not is_part.all():
            yield batch.filter(pa.array(~is_part))
        for row in batch.filter(pa.array(is_part)).select(["bucket", "chunk", "a", "b", "d", "e"]).to_pylist():
            if row["bucket"] != bucket:
                yield from _counted(parts)
                bucket, parts = row["bucket"], []
            parts.append((row["chunk"], of_planes(row["a"]), numbers(row["b"], "<u2"), of_planes(row["d"]), numbers(row["e"], "<u4")))
    yield from _counted(parts)
    trim()


def _counted(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    chunks, inline, owners, often, times = zip(*parts)
    source = np.concatenate([np.repeat(np.arange(len(chunks), dtype=np.uint32), [len(x) for x in xs]) for xs in (inline, often)])
    single = sum(map(len, inline))
    flat = np.concatenate([*inline, *often])
    owner = np.concatenate([*owners, np.zeros(len(flat) - single, dtype=np.uint16)])
    weight = np.concatenate([np.ones(single, dtype=np.int64), *(x.astype(np.int64) for x in times)])
    order = np.argsort(flat)
    flat, weight = flat[order], weight[order]
    first = run_starts(flat)
    total = np.add.reduceat(weight, first)
    counts = np.repeat(total, np.diff(np.append(first, len(flat))))
    keep = counts >= 2
    flat, counts, order = flat[keep], np.minimum(counts[keep], (1 << 32) - 1).astype("<u4"), order[keep]
    kind = source[order].astype(np.int64) * 2 + (order >= single)  # by chunk, those kept beside it last
    owner, by = owner[order], np.argsort(kind, kind="stable")
    flat, counts, owner, kind = flat[by], counts[by], owner[by], kind[by]
    cut = np.searchsorted(kind, np.arange(2 * len(chunks) + 1))
    for at in range(0, len(chunks), 200):
        some = [k for k in range(at, min(at + 200, len(chunks))) if cut[2 * k] < cut[2 * k + 2]]
        one, two = [slice(cut[2 * k], cut[2 * k + 1]) for k in some], [slice(cut[2 * k + 1], cut[2 * k + 2]) for k in some]
        yield rows(
            ROW_TYPES, len(some), kind=[FOUND] * len(some), chunk=[chunks[k] for k in some],
            a=[planes(flat[s]) for s in one], b=[owner[s].tobytes() for s in one], c=[counts[s].tobytes() for s in one],
            d=[planes(flat[s]) for s in two], e=[counts[s].tobytes() for s in two],
        )


ACTIVE = "node long, n int, center double, shingles binary"


def _assemble(table: pa.Table) -> pa.Table:
    """The documents of a chunk that may have partners: shingles that others have too, rarest first."""
    chunk = table.column("chunk")[0].as_py()
    of = {k: table.filter(pa.array(np.asarray(table.column("kind")) == k)).to_pylist() for k in (FOUND, SIDE)}
    docs = table.filter(pa.array(np.asarray(table.column("kind")) == DOCUMENT))
    seq, n = docs.column("seq").drop_null().to_numpy(), docs.filter(docs.column("seq").is_valid()).column("n").to_numpy()
    sizes = np.zeros(int(seq.max()) + 1 if len(seq) else 0, dtype=np.int64)
    sizes[seq] = n
    flat = [of_planes(x["a"]) for x in of[FOUND]]
    owner = [numbers(x["b"], "<u2") for x in of[FOUND]]
    count = [numbers(x["c"], "<u4") for x in of[FOUND]]
    often = np.concatenate([np.zeros(0, dtype=np.uint64), *(of_planes(x["d"]) for x in of[FOUND])])
    times = np.concatenate([np.zeros(0, dtype="<u4"), *(numbers(x["e"], "<u4") for x in of[FOUND])])
    order = np.argsort(often)
    often, times = often[order], times[order]
    for x in of[SIDE]:
        shingles, lengths = of_planes(x["a"]), numbers(x["c"], "<u4")
        flat.append(np.repeat(shingles, lengths))
        owner.append(numbers(x["b"], "<u2"))
        count.append(np.repeat(times[np.searchsorted(often, shingles)], lengths))
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *flat])
    owner = np.concatenate([np.zeros(0, dtype=np.uint16), *owner]).astype(np.int64)
    count = np.concatenate([np.zeros(0, dtype="<u4"), *count])
    held = np.bincount(owner, minlength=len(sizes))
    active = (held >= least_shared(sizes)) & (sizes > 0)
    keep = active[owner]
    flat, owner, count = flat[keep], owner[keep], count[keep]
    order = np.lexsort((flat, count, owner))
    flat, owner, count = flat[order], owner[order], count[order]
    chosen = np.flatnonzero(active)
    cut = np.searchsorted(owner, np.append(chosen, len(sizes)))
    center = np.bincount(owner, weights=np.log2(count), minlength=len(sizes))[chosen] / np.maximum(sizes[chosen], 1)
    return pa.table(
        {
            "node": pa.array((chunk << 16) + chosen, type=pa.int64()),
            "n": pa.array(sizes[chosen], type=pa.int32()),
            "center": pa.array(center, type=pa.float64()),
            "shingles": pa.array([flat[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])], type=pa.binary()),
        }
    )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each document's prefix; small: also where a partner is not smaller."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            sets = [numbers(x, "<u8") for x in batch.column("shingles").to_pylist()]
            n = batch.column("n").to_numpy().astype(np.int64)
            alone = n - np.array([len(x) for x in sets], dtype=np.int64)  # these come first in the order
            length = np.maximum(n - least_shared(n) + 1 - alone, 0)
            small = np.maximum(n - least_shared_with_larger(n) + 1 - alone, 0)
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, dtype="<u8"), *(x[:k] for x, k in zip(sets, length))]).view(np.int64)),
                    *(pa.array(np.repeat(batch.column(c).to_numpy(), length)) for c in ("node", "n", "center")),
                    pa.array(place < np.repeat(small, length)),
                ],
                names=["shingle", "node", "n", "center", "small"],
            )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [shared_with(*(np.sort(numbers(x, "<u8")) for x in p)) for p in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cell", "n", "m")), pa.array(shared, type=pa.int64())], names=["node", "cell", "n", "m", "shared"])


class _Classes(dict):
    """Classes joined so far, by their first name."""

    def root(self, x: int) -> int:
        while (above := self.get(x, x)) != x:
            self[x] = x = self.get(above, above)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _join(leaf: int):
    return lambda batches: _joined(batches, leaf)


def _joined(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    """Links between classes, from rows in order of (cell, part, visitor); a region's own documents are held at once."""
    key, homes, region, classes = None, [], None, _Classes()

    def links(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        found = []
        for name, n, shingles in rows:
            for y in {homes[k][0] for k in region.partners(shingles, n).tolist()}:
                if classes.join(name, y):
                    found.append((name, y))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

    def settle() -> pa.RecordBatch:
        nonlocal region, classes
        classes = _Classes()
        region = Region([x[2] for x in homes], np.array([x[1] for x in homes]), PERCENT, leaf)
        names = [x[0] for x in homes]
        common = max(set(names), key=names.count)  # links within one class tell nothing new
        return links([x for x in homes if x[0] != common])

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist()))
            rows = list(zip(batch.column("class").to_pylist(), batch.column("n").to_pylist(), (np.sort(numbers(x, "<u8")) for x in batch.column("shingles").to_pylist())))
            visitors = []
            for this, visitor, row in zip(keys, batch.column("visitor").to_pylist(), rows):
                if this != key:
                    if visitors:
                        yield links(visitors)
                        visitors = []
                    elif homes and region is None:
                        yield settle()
                    key, homes, region = this, [], None
                if not visitor:
                    homes.append(row)
                    continue
                if region is None:
                    yield settle()
                visitors.append(row)
            if visitors:
                yield links(visitors)
    if homes and region is None:
        yield settle()


#: Sizes at which a link is possible at all.
FIT = f"100L * least(na, nb) >= {PERCENT}L * greatest(na, nb)"
#: Linked sets of na and nb shingles share at least s = ceil(PERCENT (na + nb) / (100 + PERCENT)), and at most n - s of a
#: prefix are not shared: so many shingles at least are in both prefixes.
_SHARED = f"cast(ceil({PERCENT}D * (na + nb) / {100 + PERCENT}D - 1e-9) AS long)"
LEAST = "least({}, {})".format(*(f"1 - cast(ceil({PERCENT}D * {n} / 100D - 1e-9) AS long) + {_SHARED}" for n in ("na", "nb")))


def _pivots(posted: DataFrame) -> DataFrame:
    """(node, cell): the pivot of every document that has one, pivots being central documents themselves."""
    top = F.col("top.node")
    beside = posted.filter(F.col("node") != top).groupBy("node", top.alias("cell"), F.col("n").alias("na"), F.col("top.n").alias("nb")).agg(F.count("*").alias("k"), F.max("top.center").alias("center"))
    nearest = beside.filter(f"{FIT} AND k >= {LEAST}").groupBy("node").agg(F.max(F.struct("k", "center", "cell")).alias("p")).select("node", F.col("p.cell").alias("cell"))
    for _ in range(2):  # to the pivot's own pivot; how far does not matter for the result
        nearest = materialise(nearest, "near-pivots")
        above = nearest.select(F.col("node").alias("cell"), F.col("cell").alias("above"))
        nearest = nearest.join(above, "cell", "left").select("node", F.coalesce("above", "cell").alias("cell"))
    return nearest


def _regions(posted: DataFrame, active: DataFrame, crowd: int) -> DataFrame:
    """(node, cell, part, class, size) of every document with a posted shingle."""
    sets = active.select("node", "n", "shingles")
    pairs = _pivots(posted).join(sets.withColumnRenamed("shingles", "own"), "node")
    pairs = pairs.join(sets.select(F.col("node").alias("cell"), F.col("n").alias("m"), F.col("shingles").alias("other")), "cell")
    away = pairs.select("node", "cell", "n", "m", "own", "other").mapInArrow(_measured, "node long, cell long, n int, m int, shared long")
    away = away.withColumn("linked", F.expr(f"100L * shared >= {PERCENT}L * (n + m - shared)")).select("node", "cell", "linked")
    own = posted.select("node").distinct().join(away, "node", "left").select("node", F.coalesce("cell", "node").alias("cell"), F.coalesce("linked", F.col("cell").isNull()).alias("linked"))
    own = materialise(own, "near-regions")
    sizes = own.groupBy("cell").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / crowd).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    return own.join(sizes, "cell").select(
        "node",
        "cell",
        F.when(F.col("size") <= crowd, 0).when(F.col("linked"), part).otherwise(-1 - part).alias("part"),
        F.when(F.col("linked"), F.col("cell")).otherwise(F.col("node")).alias("class"),
        "size",
    )


def _visits(posted: DataFrame, regions: DataFrame) -> DataFrame:
    """(node, cell, part): the regions into whose windows a document reaches, for one direction of every pair of regions."""
    held = posted.select("shingle", "node", "n", "small").join(regions, "node")
    n, small = F.col("n"), F.when(F.col("small"), F.col("n"))
    there = held.groupBy("shingle", F.col("cell").alias("to"), F.col("part").alias("to_part")).agg(
        F.max("size").alias("to_size"),
        F.min(n).alias("least"), F.max(n).alias("most"), F.min(small).alias("small_least"), F.max(small).alias("small_most"),
        F.min("class").alias("one"), F.max("class").alias("other"),
    )
    named = lambda *names: F.struct(*(F.col(c).alias(k) for c, k in zip(names, "abc")))
    up = f"(small AND most >= n AND {PERCENT}L * least <= 100L * n)"
    down = f"(small_least <= n AND 100L * small_most >= {PERCENT}L * n)"
    return (
        held.join(there, "shingle")
        .filter(named("to_size", "to", "to_part") > named("size", "cell", "part"))
        .filter("NOT (one = class AND other = class)")
        .filter(f"{up} OR {down}")
        .select("node", "class", F.col("to").alias("cell"), F.col("to_part").alias("part"))
        .distinct()
    )


@tidy
def near_classes(docs: DataFrame, chunk: int = CHUNK, often: int = OFTEN, crowd: int = CROWD, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs`` (which comes from placed()): doc_id, place, n_shingles, component_id, first.

    Reads doc_id and text and ignores further columns. component_id is the smallest doc_id that can be reached by
    links; ``first`` marks the one row of a class that stays (smallest doc_id, null last, then place). Null texts
    and texts without words have no shingles and stand alone; repeated rows share a class; an empty table gives none.
    The options (see the constants of this module and LEAF) decide the cost, never the result.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "place", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.mapInArrow(_describe(3 * tasks, chunk, often), ROW).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    counted = materialise(dealt.mapInArrow(_frequent, ROW), "near-counted")

    described = counted.filter(f"kind = {DOCUMENT}").select("doc_id", "place", "n", "hi", "lo", (F.col("chunk") * 65536 + F.col("seq")).alias("id"))
    # Documents with equal sets are one node, named after one of them.
    names = materialise(described.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("node")), "near-names")
    own = materialise(described.join(names, ["hi", "lo", "n"], "left").select("doc_id", "place", "n", "node"), "near-own")
    chunks = counted.select("kind", "chunk", "seq", "n", "a", "b", "c", "d", "e").groupBy("chunk").applyInArrow(_assemble, ACTIVE)
    active = materialise(chunks.join(names.select("node"), "node", "left_semi"), "near-active")
    forget(counted)
    forget(names)

    listed = active.select("node", "n", "center", "shingles").mapInArrow(_posted, "shingle long, node long, n int, center double, small boolean")
    top = listed.groupBy("shingle").agg(F.max(F.struct("center", "node", "n")).alias("top"), F.count("*").alias("members")).filter("members > 1")
    posted = materialise(listed.join(top.select("shingle", "top"), "shingle"), "near-posted")
    regions = materialise(_regions(posted, active, crowd), "near-located")
    visits = materialise(_visits(posted, regions), "near-visits")
    forget(posted)

    busy = regions.groupBy("cell", "part").agg(F.min("class").alias("one"), F.max("class").alias("other")).filter("one <> other").select("cell", "part")
    busy = busy.unionByName(visits.select("cell", "part")).distinct()
    columns = ("cell", "part", "visitor", "class", "node")
    rows = regions.join(busy, ["cell", "part"]).withColumn("visitor", F.lit(False)).select(*columns)
    rows = rows.unionByName(visits.withColumn("visitor", F.lit(True)).select(*columns)).join(active.select("node", "n", "shingles"), "node")
    links = (
        rows.drop("node").repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "visitor").mapInArrow(_join(leaf), "a long, b long")
    )
    roots = components(materialise(links, "near-links")).select(F.col("node").alias("class"), "root")
    classes = regions.select("node", "class").join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("class"))

    named = own.join(classes, "node", "left").select("doc_id", "place", "n", F.coalesce("class", "node").alias("class"))
    named = materialise(named, "near-named")
    for done in (own, active, regions, visits):
        forget(done)
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "place")
    heads = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min_by("place", order).alias("head"))
    return named.join(heads, "class", "left").select(
        "doc_id",
        "place",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("class").isNull() | (F.col("head") == F.col("place"))).alias("first"),
    )


@tidy
def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """near_classes() of any table: doc_id, n_shingles, component_id."""
    return near_classes(placed(docs), **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class; all its columns as they are."""
    return without(docs, lambda located: near_classes(located, **options).filter("NOT first"), "near-gone")
