"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Every trusted row that isn't held out is training text. No table of n-grams is ever held as a whole: tokens are dealt to
shards by the middle word of their trigram (u, v, w), where all counts meet that its probability needs, those of (u, v,
w), (u, v), (v, w) and v. Training counts are merged shard by shard. A chunk of documents sends its distinct trigrams to
the shards, with the documents they occur in, and gets each document's sum over a shard back. What every task holds are
the vocabulary (a hash and a number for each word) and the single tokens' probabilities. Thresholds are quantiles,
language by language, over all trusted rows that were kept out of training.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .blobs import of_planes, planes, rows, run_starts, spread
from .common import BATCHES, forget, held, materialise, settings, tidy, trim, without
from .lm_score import FILTER_BITS, _near_targets
from .ngrams import Numbers, lookup, slices

#: Bits of a token, and those in the keys of Model.two and Model.three.
TOKEN_BITS, BITS = 31, 21
MASK = (1 << TOKEN_BITS) - 1
#: The start of a text; and by the number of equal words before it, up to four, a word that repeats.
START = 1
REPEATS = np.array([-1, 0, 2, 3, 4], dtype=np.int64)
#: Token = base * FORMS + form; bases below FIRST_WORD are shapes of words outside the vocabulary.
FORMS, FIRST_WORD = 6, 16
#: Tokens and documents of a chunk; a chunk ends with the text that reaches either.
CHUNK, CHUNK_DOCS = 500_000, 60_000
#: Documents meet the model in so many rounds, so that no more than such a share of their trigrams lies on disk at once.
ROUNDS = 2
#: Trigrams in a row of the model.
PIECE = 1_000_000
#: Sums over a shard are rounded to this unit, so that their total does not depend on their order.
UNIT = 2.0**-32
#: Spreads tokens over the shards.
ODD = 0x9E3779B1

#: Exchanged files are deleted when a query ends, not when the driver happens to collect garbage.
LEAN = BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

MODEL, PART, DOCUMENT, SUM, SINGLE, COUNTS = range(6)
TYPES = {"kind": pa.int32(), "shard": pa.int32(), "chunk": pa.int64(), "seq": pa.int32(), "n": pa.int64(), "doc_id": pa.int64()}
TYPES |= {"place": pa.string(), "lang": pa.string()} | {c: pa.binary() for c in "abcd"}
ROW = "kind int, shard int, chunk long, seq int, n long, doc_id long, place string, lang string, a binary, b binary, c binary, d binary"
RESULT = "doc_id long, place string, lang string, n_tokens long, loss double"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def core_of(word: bytes) -> bytes:
    return word.lower().strip(MARKS)


def shape_of(core: bytes) -> int:
    """The class of a word that the vocabulary lacks."""
    if not core:
        return 1
    if any(48 <= c <= 57 for c in core):
        return 2
    if any(c < 128 and not 97 <= c <= 122 for c in core):
        return 3
    n = len(core.decode("utf-8", "replace"))
    return 4 + sum(n > k for k in (2, 4, 6, 8, 10, 12, 16, 24))


def form_of(word: bytes, core: bytes) -> int:
    """How a word is written: plain, with one usual mark after it, otherwise marked; and whether in capitals."""
    text = word.decode("utf-8", "replace")
    capitals = 3 if len(core) > 1 and text.isupper() else 0
    if len(core) == len(word):
        return capitals
    usual = len(core) + 1 == len(word) and word[-1] in b".,;:!?"
    return capitals + (1 if usual else 2)


class Vocabulary:
    """core -> number, by the 64-bit hashes of the words in ascending order and their numbers."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers, self._view = hashes, numbers, memoryview(hashes)

    def __reduce__(self):
        return Vocabulary, (self.hashes, self.numbers)

    def __len__(self) -> int:
        return len(self.hashes)

    def get(self, core: bytes) -> int | None:
        wanted = hash_of(core)
        at = bisect_left(self._view, wanted)
        return int(self.numbers[at]) if at < len(self._view) and self._view[at] == wanted else None


def hash_of(core: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(core) - (1 << 63)


def numbering(vocabulary: Vocabulary | dict[bytes, int]) -> Numbers:
    """word -> token in the low bits, with a hash of the core above it that tells repetitions."""
    from zlib import crc32

    def number(word: bytes) -> int:
        core = core_of(word)
        base = vocabulary.get(core) if core else None
        token = (FIRST_WORD + base if base is not None else shape_of(core)) * FORMS + form_of(word, core)
        return (crc32(core or word) << TOKEN_BITS) | token

    return Numbers(number)


def tokens_of(numbers: Numbers, text: bytes) -> np.ndarray:
    return tokens_of_all(numbers, [text])[0]


def tokens_of_all(numbers: Numbers, texts: list[bytes]) -> list[np.ndarray]:
    """The tokens of each text; words that repeat the one before them are tokens of REPEATS."""
    return [_with_repeats(packed) for packed in numbers.of_all(texts)]


def _with_repeats(packed: np.ndarray) -> np.ndarray:
    tokens, core = packed & MASK, packed >> TOKEN_BITS
    if len(core) > 1:
        place = np.arange(len(core))
        new = np.concatenate([[True], core[1:] != core[:-1]])
        run = np.minimum(place - np.maximum.accumulate(np.where(new, place, 0)), len(REPEATS) - 1)
        tokens = np.where(run > 0, REPEATS[run], tokens)
    return tokens


def _contexts(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of all texts in a row: the two before each, and the token."""
    pad = np.array([START, START], dtype=np.int64)
    whole = np.concatenate([x for t in tokens for x in (pad, t)] or [pad])
    inside = np.ones(len(whole), dtype=bool)
    ends = np.cumsum([len(t) + 2 for t in tokens] or [2])
    begins = np.concatenate([[0], ends[:-1]])
    inside[begins] = inside[begins + 1] = False
    at = np.flatnonzero(inside)
    u, v, w = whole[at - 2], whole[at - 1], whole[at]
    # Repetition doesn't explain repetition: after one, a context begins anew.
    again = v < FORMS
    return np.where(again | (u < FORMS), START, u), np.where(again, START, v), w


def discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams occur 1, 2, 3 and 4 times."""
    n = [counts.get(k, 0) for k in range(1, 5)]
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _discount(n: np.ndarray, d: list[float]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


def _shares(context: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The discounted share of each n-gram in its context; the contexts, and the mass that each leaves for shorter n-grams."""
    order = np.argsort(context, kind="stable")
    first = run_starts(context[order])
    if not len(first):
        return np.zeros(0), context, np.zeros(0)
    inside = np.diff(np.append(first, len(n)))
    total = np.empty(len(n), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], first), inside)
    part = _discount(n, d) / total
    return part, context[order][first], 1 - np.add.reduceat(part[order], first)


def _spread(v: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the tokens, under which the shards are ranges."""
    return (v * ODD) & ((1 << bits) - 1)


def _sorted(u, v, w, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the trigrams by pair (spread v, and w) and u; where a new one begins; each one's pair and u."""
    pair = _spread(v, bits) << bits | w
    if 3 * bits < 64:
        key = pair << bits | u
        order = np.argsort(key, kind="stable")
        first = run_starts(key[order])
    else:
        order = np.lexsort((u, pair))
        first = run_starts(pair[order], u[order])
    return order, first, pair[order[first]], u[order[first]]


def _cuts(pair: np.ndarray, bits: int, shards: int) -> list[tuple[int, slice]]:
    """The shards that have some of the ascending pairs, with their places."""
    edges = np.array([-(-(k << bits) // shards) << bits for k in range(1, shards)], dtype=np.int64)
    cut = np.concatenate([[0], np.searchsorted(pair, edges), [len(pair)]])
    return [(k, slice(cut[k], cut[k + 1])) for k in range(shards) if cut[k] < cut[k + 1]]


def _pack(x: np.ndarray) -> bytes:
    raw = planes(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) if len(x) > 8 else b""
    return of_planes(raw, kind)


def _pack_trigrams(pair: np.ndarray, u: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [_pack(np.diff(pair, prepend=0).astype("u8")), _pack(u.astype("u4")), _pack(n.astype("u4"))]


def _unpack_trigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(row["a"], "i8")), _unpack(row["b"], "u4").astype(np.int64), _unpack(row["c"], "u4").astype(np.int64)


def _merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of all parts in order, with their counts."""
    pair, u, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*parts) if parts else ([], [], [])))
    order = np.lexsort((u, pair))
    pair, u, n = pair[order], u[order], n[order]
    first = run_starts(pair, u)
    return pair[first], u[first], np.add.reduceat(n, first) if len(first) else n


class Tables:
    """The model's tables for some trigrams (pair, u) in ascending order with counts n: a whole shard or all of them."""

    def __init__(self, bits: int, d3: list[float], d2: list[float], one: np.ndarray, pair: np.ndarray, u: np.ndarray, n: np.ndarray):
        self.bits, self.one = bits, one
        first = run_starts(pair)
        before = np.diff(np.append(first, len(pair)))  # below the highest order an n-gram counts once for every word before it
        self.pair = pair[first]
        self.part2, *self.weight2 = _shares(self.pair >> bits, before, d2)
        self.trigram = np.repeat(np.arange(len(first)), before) << bits | u
        self.part3, *self.weight3 = _shares((pair >> bits) << bits | u, n, d3)

    def losses(self, pair: np.ndarray, u: np.ndarray) -> np.ndarray:
        """-log P(w | u v), natural, for trigrams in order of their pairs."""
        first = run_starts(pair)
        inside = np.diff(np.append(first, len(pair)))
        kinds = pair[first]
        v = kinds >> self.bits
        rank = lookup(self.pair, np.arange(len(self.pair)), kinds, -1)
        two = np.where(rank >= 0, self.part2[rank], 0.0) if len(self.pair) else np.zeros(len(kinds))
        two += lookup(*self.weight2, v, 1.0) * self.one[kinds & ((1 << self.bits) - 1)]
        rank, two, v = (np.repeat(x, inside) for x in (rank, two, v))
        three = lookup(self.trigram, self.part3, rank << self.bits | u, 0.0)
        return -np.log(three + lookup(*self.weight3, v << self.bits | u, 1.0) * two)


class Model:
    """An interpolated trigram model: the vocabulary, the single tokens' probabilities, discounts, and ``counts``.

    ``counts`` is a table of all trigrams of the training text with their counts, dealt into ``shards`` shards.
    """

    def __init__(self, vocabulary: Vocabulary, counts: DataFrame, shards: int, bits: int, d3: list[float], d2: list[float], one: np.ndarray):
        self.vocabulary, self.counts, self.shards, self.bits = vocabulary, counts, shards, bits
        self.d3, self.d2, self.one = d3, d2, one

    @cached_property
    def whole(self) -> Tables:
        """All tables at once, to look at small models; scoring never asks for it."""
        found = self.counts.filter(f"kind = {MODEL}").select("a", "b", "c").toArrow().to_pylist()
        return Tables(self.bits, self.d3, self.d2, self.one, *_merge([_unpack_trigrams(x) for x in found]))

    def _keys(self, pair: np.ndarray) -> np.ndarray:
        v = ((pair >> self.bits) * pow(ODD, -1, 1 << self.bits)) & ((1 << self.bits) - 1)
        return v << BITS | pair & ((1 << self.bits) - 1)

    @property
    def two(self) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of a small model as v << BITS | w, ascending, and their discounted shares."""
        keys = self._keys(self.whole.pair)
        order = np.argsort(keys)
        return keys[order], self.whole.part2[order]

    @property
    def three(self) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of a small model as u << 2 * BITS | v << BITS | w, ascending, and their discounted shares."""
        rank, u = self.whole.trigram >> self.bits, self.whole.trigram & ((1 << self.bits) - 1)
        keys = u << 2 * BITS | self._keys(self.whole.pair)[rank]
        order = np.argsort(keys)
        return keys[order], self.whole.part3[order]

    def losses(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """-log P(w | u v), natural, under a small model."""
        pair = _spread(v, self.bits) << self.bits | w
        order, out = np.argsort(pair), np.empty(len(pair))
        out[order] = self.whole.losses(pair[order], u[order])
        return out


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("quality", bool)  # what other kinds of tasks kept goes
    for _, texts in slices(batches):
        found = Counter(core_of(w) for text in texts for w in text.split())
        found.pop(b"", None)
        hashes = [hash_of(x) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, type=pa.int64()), pa.array(list(found.values()), type=pa.int64())], names=["core", "n"])


def _count(shared, bits: int, shards: int, chunk_tokens: int):
    """The distinct trigrams of the texts, chunk by chunk, with their counts, dealt into shards."""

    def dealt(tokens: list[np.ndarray]) -> pa.RecordBatch:
        order, first, pair, u = _sorted(*_contexts(tokens), bits)
        n = np.diff(np.append(first, len(order)))
        cuts = _cuts(pair, bits, shards)
        found = [_pack_trigrams(pair[s], u[s], n[s]) for _, s in cuts]
        return rows(TYPES, len(cuts), kind=[PART] * len(cuts), shard=[k for k, _ in cuts], **{c: [x[i] for x in found] for i, c in enumerate("abc")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", bool)  # what other kinds of tasks kept goes
        numbers, tokens, size = numbering(shared.value), [], 0
        for _, texts in slices(batches):
            for found in tokens_of_all(numbers, texts):
                tokens.append(found)
                size += len(found)
                if size >= chunk_tokens:
                    yield dealt(tokens)
                    tokens, size = [], 0
        if size:
            yield dealt(tokens)
        trim()

    return run


def _merged(bits: int):
    """For each shard, from rows in order of their shard: its trigrams, its bigrams by last word, and counts of counts."""

    def whole(shard: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        pair, u, n = _merge(parts)
        for at in range(0, len(pair), PIECE):
            a, b, c = _pack_trigrams(*(x[at : at + PIECE] for x in (pair, u, n)))
            yield rows(TYPES, 1, kind=[MODEL], shard=[shard], a=[a], b=[b], c=[c])
        first = run_starts(pair)
        before = np.diff(np.append(first, len(pair)))
        last, times = np.unique(pair[first] & ((1 << bits) - 1), return_counts=True)
        yield rows(TYPES, len(last), kind=[SINGLE] * len(last), seq=pa.array(last.astype(np.int32)), n=pa.array(times.astype(np.int64)))
        seen = [np.bincount(np.minimum(x, 5), minlength=6).astype(np.int64) for x in (n, before)]
        yield rows(TYPES, 1, kind=[COUNTS], a=[seen[0].tobytes()], b=[seen[1].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", bool)  # what other kinds of tasks kept goes
        shard, parts, size, most = None, [], 0, 0
        for batch in batches:
            for row in batch.select(["shard", "a", "b", "c"]).to_pylist():
                if row["shard"] != shard:
                    if parts:
                        yield from whole(shard, parts)
                    shard, parts, size, most = row["shard"], [], 0, PIECE
                parts.append(_unpack_trigrams(row))
                size += len(parts[-1][0])
                if size > most:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    most = 2 * size + PIECE
        if parts:
            yield from whole(shard, parts)
        trim()

    return run


def train(texts: DataFrame, min_count: int = 4, chunk: int = CHUNK) -> Model:
    """A model of all of ``texts``; words of fewer than ``min_count`` places are read as their shape, at every size.

    ``chunk`` decides the cost, never the result.
    """
    spark = texts.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, LEAN):
        counted = texts.mapInArrow(_cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).toArrow()
    hashes, n = (counted.column(c).to_numpy() for c in ("core", "n"))
    often = np.lexsort((hashes, -n))  # small numbers for frequent words, which pack better
    ordinal = np.empty(len(hashes), dtype=np.int32)
    ordinal[often] = np.arange(len(hashes))
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[order], ordinal[order])
    kinds = (FIRST_WORD + len(vocabulary)) * FORMS
    bits = kinds.bit_length()
    if bits > TOKEN_BITS:
        raise ValueError(f"{len(vocabulary)} words are more than tokens of {TOKEN_BITS} bits can tell apart")

    shared = spark.sparkContext.broadcast(vocabulary)
    dealt = texts.mapInArrow(_count(shared, bits, shards, chunk), ROW).repartition(shards, "shard").sortWithinPartitions("shard")
    counts = materialise(dealt.mapInArrow(_merged(bits), ROW), "kn-counts", LEAN)
    shared.destroy()
    seen = counts.filter(f"kind = {COUNTS}").select("a", "b").collect()
    d3, d2 = (discounts(dict(enumerate(sum((np.frombuffer(x[c], dtype=np.int64) for x in seen), np.zeros(6, dtype=np.int64)).tolist()))) for c in "ab")
    single = counts.filter(f"kind = {SINGLE}").groupBy("seq").agg(F.sum("n").alias("n")).toArrow()  # at most ``kinds`` rows
    token, n = (single.column(c).to_numpy() for c in ("seq", "n"))
    order = np.argsort(token)
    d1 = discounts(dict(enumerate(np.bincount(np.minimum(n, 5), minlength=6).tolist())))
    part, _, left = _shares(np.zeros(len(n), dtype=np.int64), n[order], d1)
    one = np.full(kinds, (left[0] if len(left) else 1.0) / kinds)
    one[token[order]] += part
    return Model(vocabulary, counts, shards, bits, d3, d2, one)


def _deal(shared, bits: int, shards: int, chunk_tokens: int):
    """A row per document, and the distinct trigrams of every chunk with the documents they are in, dealt into shards."""

    def dealt(chunk: int, tokens: list[np.ndarray]) -> pa.RecordBatch:
        order, first, pair, u = _sorted(*_contexts(tokens), bits)
        owner = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(t) for t in tokens])[order]
        times, places = np.diff(np.append(first, len(order))), np.append(first, len(order))
        cuts = _cuts(pair, bits, shards)
        found = [[*_pack_trigrams(pair[s], u[s], times[s]), _pack(owner[places[s.start] : places[s.stop]])] for _, s in cuts]
        return rows(
            TYPES, len(cuts), kind=[PART] * len(cuts), shard=[k for k, _ in cuts], chunk=[chunk] * len(cuts),
            **{c: [x[i] for x in found] for i, c in enumerate("abcd")},
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", bool)  # what other kinds of tasks kept goes
        numbers = numbering(shared.value)
        chunk, tokens, size = TaskContext.get().partitionId() << 25, [], 0
        for batch, texts in slices(batches):
            chunks, seqs, ns = [], [], []
            for found in tokens_of_all(numbers, texts):
                chunks.append(chunk)
                seqs.append(len(tokens))
                ns.append(len(found))
                tokens.append(found)
                size += len(found)
                if size >= chunk_tokens or len(tokens) >= CHUNK_DOCS:
                    yield dealt(chunk, tokens)
                    chunk, tokens, size = chunk + 1, [], 0
            yield rows(
                TYPES, len(ns), kind=[DOCUMENT] * len(ns), shard=[spread(x + k, shards) for k, x in enumerate(chunks)], chunk=chunks, seq=seqs, n=ns,
                **{c: batch.column(c) for c in ("doc_id", "place", "lang")},
            )
        if size:
            yield dealt(chunk, tokens)
        trim()

    return run


def _summed(shared):
    """Each document's sum over the trigrams of a shard, from rows in order of shard and kind: first the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", bool)  # what other kinds of tasks kept goes
        bits, d3, d2, one = shared.value
        shard, model, tables = None, [], None
        for batch in batches:
            document = np.asarray(batch.column("kind")) == DOCUMENT
            if document.any():
                yield batch.filter(pa.array(document))
            for row in batch.filter(pa.array(~document)).select(["kind", "shard", "chunk", *"abcd"]).to_pylist():
                if row["shard"] != shard:
                    shard, model, tables = row["shard"], [], None
                if row["kind"] == MODEL:
                    model.append(_unpack_trigrams(row))
                    continue
                if tables is None:
                    tables, model = Tables(bits, d3, d2, one, *_merge(model)), []
                pair, u, times = _unpack_trigrams(row)
                owner = _unpack(row["d"], "u2")
                sums = np.bincount(owner, weights=np.repeat(tables.losses(pair, u), times))
                there = np.flatnonzero(np.bincount(owner))
                yield rows(TYPES, 1, kind=[SUM], chunk=[row["chunk"]], a=[_pack(there.astype("u2"))], b=[_pack(np.rint(sums[there] / UNIT).astype("i8"))])
        trim()

    return run


def _chunk(table: pa.Table) -> pa.Table:
    """The documents of a chunk with all their sums."""
    kind = np.asarray(table.column("kind"))
    docs = table.filter(pa.array(kind == DOCUMENT))
    sums = np.zeros(docs.num_rows, dtype=np.int64)
    for x in table.filter(pa.array(kind == SUM)).select(["a", "b"]).to_pylist():
        sums[_unpack(x["a"], "u2")] += _unpack(x["b"], "i8")
    loss = sums[docs.column("seq").to_numpy()] * UNIT
    return pa.table({c: docs.column(c) for c in ("doc_id", "place", "lang")} | {"n_tokens": docs.column("n"), "loss": pa.array(loss)})


def score(docs: DataFrame, model: Model, chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, place, lang of ``docs``, with n_tokens and loss (the sum of -log P over the tokens); written.

    ``chunk`` and ``rounds`` decide the cost, never the result.
    """
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(model.vocabulary)  # 12 bytes a word
    shared = context.broadcast((model.bits, model.d3, model.d2, model.one))  # 8 bytes a token
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "place", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    tables = model.counts.filter(f"kind = {MODEL}")
    scored = None
    for number in range(rounds):
        own = read.filter(F.pmod(F.xxhash64("place"), F.lit(rounds)) == number)
        dealt = own.mapInArrow(_deal(vocabulary, model.bits, model.shards, chunk), ROW).unionByName(tables)
        met = dealt.repartition(model.shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_summed(shared), ROW).drop("shard")
        found = materialise(met.groupBy("chunk").applyInArrow(_chunk, RESULT), "kn-scores", LEAN)
        scored = found if scored is None else scored.unionByName(found)
    vocabulary.destroy()
    shared.destroy()
    return scored


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the rows of ``docs`` whose doc_id is in ``ids`` (doc_id, distinct); written.

    A filter of a fixed size keeps most other texts from being moved, whatever the number of ids.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_near_targets(ids))  # FILTER_BITS bits

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", bool)  # what other kinds of tasks kept goes
        for batch in batches:
            at = batch.column("at").to_numpy().astype(np.uint64)
            yield batch.filter(pa.array(((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)))

    own = F.col("doc_id").cast("long").alias("doc_id")
    read = docs.filter("text IS NOT NULL").select(own, "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("at"))
    chosen = read.mapInArrow(near, "doc_id long, text string, at long").join(ids.hint("merge"), "doc_id", "left_semi")
    out = materialise(chosen.select("text"), "kn-text", LEAN)
    bits.destroy()
    return out


def _quantile(rated: DataFrame, quantile: float, *by: str) -> DataFrame:
    """The smallest score that at least a share ``quantile`` of the rows does not exceed, exactly; by the columns ``by``."""
    group = Window.partitionBy(*by)
    ranked = rated.select(*by, "score", F.row_number().over(group.orderBy("score")).alias("at"), F.count("*").over(group).alias("of"))
    return ranked.filter(F.col("at") == F.greatest(F.ceil(F.round(F.col("of") * quantile, 6)), F.lit(1))).select(*by, F.col("score").alias("own"))


@tidy
def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: float = 0.3,
    quantile: float = 0.998,
    prior: float = 30.0,
    least: int = 1,
) -> DataFrame:
    """One row per row of ``docs`` (from placed()): doc_id, place, lang, n_tokens, perplexity, score, threshold, kept.

    ``labels`` has doc_id and trusted (boolean); null ids and repeated ids are harmless. A share ``held_out`` of
    the trusted ids, chosen by hash, sets the thresholds; the model is trained on all rows of all other trusted ids.
    ``score`` is the mean loss with ``prior`` tokens of the language's mean added, so that a few unknown words do not
    condemn a short text. A document is kept unless its score exceeds its language's quantile;
    languages with fewer than ``least`` held-out rows, by default those with none, take the mean and the quantile over
    all languages, and without any threshold every document is kept. Null and empty texts have no perplexity and are kept. Further columns are ignored.
    """
    trusted = labels.filter("trusted AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(1000 * held_out)
    trusted = materialise(trusted, "kn-ids")
    texts = texts_of(docs, trusted.filter(~aside))
    model = train(texts)
    forget(texts)
    scored = score(docs, model)
    forget(model.counts)

    known = scored.join(trusted.filter(aside), "doc_id", "left_semi").filter("n_tokens > 0")
    means = known.groupBy("lang").agg((F.sum("loss") / F.sum("n_tokens")).alias("mean"), F.count("*").alias("rows"))
    total = known.agg((F.sum("loss") / F.sum("n_tokens")).alias("mean")).first()[0]
    means = materialise(means.filter(F.col("rows") >= least), "kn-means")
    mean = F.coalesce("mean", F.lit(total).cast("double"))
    smooth = ((F.col("loss") + prior * mean) / (F.col("n_tokens") + prior)).alias("score")
    rated = known.join(means, "lang", "left").select("lang", smooth)
    rated = materialise(rated, "kn-rated")
    overall = next((r["own"] for r in _quantile(rated, quantile).collect()), None)
    limits = _quantile(rated.join(means.select("lang"), "lang", "left_semi"), quantile, "lang")
    limits = materialise(means.select("lang", "mean").join(limits, "lang", "left"), "kn-limits")
    threshold = F.coalesce("own", F.lit(overall).cast("double")).alias("threshold")
    return (
        scored.join(limits, "lang", "left")
        .select("doc_id", "place", "lang", "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(F.col("loss") / F.col("n_tokens"))).alias("perplexity"), smooth, threshold)
        .withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)))
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that classify() rejects; all its columns as they are."""
    return without(docs, lambda located: classify(located, labels, **options).filter("NOT kept"), "kn-gone")
