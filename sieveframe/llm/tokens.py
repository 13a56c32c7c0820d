"""Encoding of whole texts with a file of the ``tokenizers`` library, each distinct chunk once.

A text is cut before white space that follows something else; neither kind of pre-tokenizer lets a token cross such a
place or looks further back, so the ids of a text are the ids of its chunks in a row. Most texts have single spaces
and line ends only, which need no pattern to be cut. A chunk of letters is one pre-token, so the library's model
encodes it directly; all other chunks go through the whole tokenizer. Texts with control characters on whose class
Python and the tokenizer differ are encoded in one piece. Chunks that a worker has met lately are kept in two
generations of bounded size; a miss costs time, never a result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: White space and the rest; both kinds of tokenizer file are cut here.
CHUNK = re.compile(r"\s*\S+|\s+")
#: A text without this is cut at its spaces and line ends.
RUN = re.compile(r"[ \n]\s")
#: Characters that Python calls white space and the tokenizer does not, or the other way round; and NUL, the mark below.
ODD = re.compile(r"[\x00\x1c-\x1f\x85᠎​﻿]")
#: The same for Arrow's patterns.
ODD_RE2 = r"[\x00\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]"
RUN_RE2 = r"[ \n][\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts whose distinct chunks are looked up together.
ROWS = 1200
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}
#: Chunks that a worker keeps.
KEEP = 600_000
#: A long text is cut into chunks piece by piece, to bound what is held at once.
PIECE = 1 << 20
CUT = re.compile(r"(?<=\S)(?=\s)")
#: Letters which lower-casing and normalisation map one by one.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+")
#: Marks that make one pre-token after letters (an apostrophe might not).
MARKS = re.compile(r"[.,;:!?|]+")

#: The printable stand-in of every byte in a byte-level vocabulary: printable bytes stand for themselves.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _SELF]
STAND_IN = {b: chr(b) for b in _SELF} | {b: chr(256 + n) for n, b in enumerate(_OTHER)}


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut where a chunk begins."""
    at = 0
    while len(text) - at > PIECE:
        found = CUT.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def chunks_of(text: str) -> list[str]:
    """Keys of the chunks: of one that begins with a space, what follows it; NUL and the chunk of one that doesn't."""
    if RUN.search(text):
        return [x[1:] if x[0] == " " and len(x) > 1 and x[1] != "\n" else "\0" + x for x in CHUNK.findall(text)]
    cut = text.replace("\n", " \n").split(" ")
    cut[0] = "\0" + cut[0]
    return cut


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key


class _Known(dict):
    """key of a chunk -> its ids; what is missing is taken from the generation before, or learnt."""

    def __init__(self, learn, before: dict[str, bytes]):
        self.learn, self.before = learn, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.learn(key)
        self[key] = ids
        return ids


class ChunkEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.keep, self.known, self.parts = keep, _Known(self._learn, {}), {}
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        # Whether the tokenizer lower-cases, and whether the space before a word is part of its token.
        self.lower = self._plain_ids("A") == self._plain_ids("a")
        self.spaced = self._plain_ids(" a") != self._plain_ids("a")
        # Where white space leaves no trace, words are chunks, whatever stands between them.
        self.cut = str.split if self._plain_ids(" a \n\n\tb ") == self._plain_ids("a b") else chunks_of

    def _plain_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> bytes:
        return np.array(self._plain_ids(text), dtype="<u4").tobytes()

    def _word(self, word: str, space: bool) -> bytes:
        """The ids of PLAIN letters, with or without a space before them."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(STAND_IN)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize("Ġ" + word if space and self.spaced else word)])

    def _learn(self, key: str) -> bytes:
        if self.cut is str.split:
            if len(words := key.split()) != 1 or words[0] != key:
                return b"".join([self.known[w] for w in words])
        at = 1 if key[:1] in ("\0", "\n") else 0
        found = PLAIN.match(key, at)
        end = found.end() if found else at
        if not found or end < len(key) and not MARKS.fullmatch(key, end):
            return self._ids(chunk_of(key))
        if self.lower and (low := key.lower()) != key:
            return self.known[low]
        # The line end, the letters and the marks are pre-tokens of their own.
        if end == len(key) and key[0] != "\n":
            return self._word(key[at:], not at)
        core = key[at:end]
        ids = self.known[core if not at or not self.spaced else "\0" + core]
        if key[0] == "\n":
            ids = self._part("\n") + ids
        return ids + self._part(key[end:]) if end < len(key) else ids

    def _part(self, text: str) -> bytes:
        if text not in self.parts:
            if len(self.parts) > 10_000:
                self.parts.clear()
            self.parts[text] = self._ids(text)
        return self.parts[text]

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null counts as empty), each text's followed by ``end_id``, and their numbers."""
        self._renew()
        texts = pc.fill_null(texts, "")
        single = pc.or_(pc.match_substring_regex(texts, ODD_RE2 if self.cut is str.split else f"{ODD_RE2}|{RUN_RE2}"), pc.greater(pc.binary_length(texts), PIECE))
        alone = np.asarray(single)
        ids, counts = self._encode_words(texts.filter(pc.invert(single)) if alone.any() else texts)
        if alone.any():
            parts, own = np.empty(len(alone), dtype=object), [np.frombuffer(x, dtype="<u4") for x in self.encode(texts.filter(single).to_pylist())]
            parts[~alone] = np.array([*np.split(ids, np.cumsum(counts)[:-1]), None], dtype=object)[:-1] if len(counts) else []
            for at, x in zip(np.flatnonzero(alone), own):
                parts[at] = x
            ids, counts = np.concatenate(list(parts)), np.array([len(x) for x in parts], dtype=np.int64)
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are cut at single spaces: each distinct chunk of the column is looked up once."""
        if self.cut is not str.split:
            texts = pc.replace_substring(pc.binary_join_element_wise("\0", texts, ""), "\n", " \n")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        found = list(map(self.known.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()))
        # Batches hold less than 2**31 ids: each row is at most PIECE long.
        lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(lengths, dtype=np.int32) - lengths
        which = chunks.indices.to_numpy()
        own = lengths[which]
        ends = np.cumsum(own, dtype=np.int32)
        places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        places += np.repeat(starts[which] - ends + own, own)
        ids = flat[places]
        upto = np.concatenate([[0], ends])[np.cumsum(lists.value_lengths().to_numpy())]
        del lists, chunks, texts
        pa.default_memory_pool().release_unused()
        return ids, np.diff(upto, prepend=0).astype(np.int64)

    def _renew(self) -> None:
        if len(self.known) > self.keep:  # a new generation; the one before the last is forgotten
            self.known.before = {}
            self.known = _Known(self._learn, self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            self._renew()
            if ODD.search(text):
                out.append(self._ids(text))
            else:
                get = self.known.__getitem__
                out.append(b"".join([b"".join(map(get, self.cut(piece))) for piece in pieces(text)]))
        return out


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(f"encoder {path}", lambda: ChunkEncoder(path))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
