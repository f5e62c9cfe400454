"""Operator 13: byte-level BPE by chunks that documents share, with repaired joins."""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import Vocabulary, read_ranks
from plumbline.llm.chunks import ship
from plumbline.llm.words import BYTE_BASE, rolling, slices, utf8

#: Pieces of the byte-level files (a fixed value), which are merged separately.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a piece's start looks ahead at: a quote and two letters.
AHEAD = 3
#: A chunk ends where the hash of the last WINDOW bytes is divisible by SPACING, its length on average.
WINDOW, SPACING = 16, 128
CACHE_CHUNKS, CACHE_PIECES = 100_000, 300_000
SLICE = 1_000_000


def alphabet() -> dict[str, int]:
    """Byte of each character of the files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class JsonVocabulary(Vocabulary):
    """Tokens, merges and special tokens of a byte-level BPE file in JSON; only listed merges are made."""

    def __init__(self, body: bytes):
        file = json.loads(body)
        model, before = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or file["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters, vocab = alphabet(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in vocab.items():
            tokens[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.ranks = {tokens[k]: k for k in vocab.values()}
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("the ids of merged tokens must rise in order of the merges")
        order = sorted((vocab[a] * len(tokens) + vocab[b], m) for (a, b), m in zip(merges, made))
        self.pairs, self.made = (np.array(c, np.int64) for c in zip(*order))
        self.cache = {}
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")


class Chunk:
    """A chunk encoded by itself: starts of its pieces, ids as 32-bit integers and where each piece's begin, and how many pieces the end cannot change."""

    __slots__ = ("starts", "first", "ids", "safe", "length")

    def __init__(self, text: str, pieces: list[str], ids: list[bytes]):
        self.length = len(text)
        self.starts = array("i", accumulate(map(len, pieces), initial=0))
        self.starts.pop()
        self.first = array("i", accumulate(map(len, ids), initial=0))
        self.ids = b"".join(ids)
        self.safe = min(len(pieces) - 1, bisect_right(self.starts, len(text) - AHEAD))


class Encoder:
    """Encodes texts through bounded caches of chunks and pieces; one per Python worker."""

    def __init__(self, vocab: JsonVocabulary):
        self.vocab = vocab
        self.pattern = regex.compile(PIECE)
        self.chunks: dict[str, Chunk] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> dict[str, Chunk]:
        """The chunks with their ids; those not known yet are encoded, each once."""
        known = {c: self.chunks.get(c) for c in chunks}
        new = [c for c, made in known.items() if made is None]
        pieces = [self.pattern.findall(c) for c in new]
        ids = self.merged(chain.from_iterable(pieces))
        for c, own in zip(new, pieces):
            known[c] = Chunk(c, own, list(map(ids.__getitem__, own)))
        if len(self.chunks) + len(new) > CACHE_CHUNKS:
            self.chunks.clear()
        self.chunks.update(islice(((c, known[c]) for c in new), CACHE_CHUNKS))
        return known

    def merged(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces; those not known yet are merged together, each once."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        distinct = set(pieces)
        new = [p for p in distinct if p not in self.pieces]
        merged = self.vocab.merge([p.encode() for p in new])
        ends = list(accumulate((4 * len(ids) for ids in merged), initial=0))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, ends[-1] // 4).tobytes()
        self.pieces.update((p, flat[a:b]) for p, a, b in zip(new, ends, ends[1:]))
        return self.pieces

    def join(self, text: str, chunks: list[Chunk], out: list[bytes | str]) -> None:
        """Put the ids of ``text``, or its pieces where they are to be encoded anew, into ``out``.

        Pieces of a chunk hold once one of them begins where a piece of the text begins,
        as matching never looks back; those near its end may go on in the next chunk.
        There, pieces are matched in the whole text until one ends where a piece of the
        chunk around it begins; from that agreement on the chunk's ids hold again.
        """
        last, at, here, begin = len(chunks) - 1, 0, 0, 0
        while here <= last:
            chunk = chunks[here]
            safe = len(chunk.starts) if here == last else chunk.safe
            k = bisect_left(chunk.starts, at - begin)
            if k < safe and chunk.starts[k] == at - begin:
                out.append(chunk.ids[chunk.first[k] : chunk.first[safe]])
                at = begin + (chunk.length if here == last else chunk.starts[safe])
            if at < begin + chunk.length:
                end = self.pattern.match(text, at).end()
                out.append(text[at:end])
                at = end
            while here <= last and at >= begin + chunks[here].length:
                begin += chunks[here].length
                here += 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the first id of each text."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        cuts = chunk_cuts(data, offsets)
        parts: list[list[str]] = []
        segments: list[list[str | int]] = []
        for text, own in zip(texts, cuts):
            segments.append([])
            for a, b, mark in self.segments(text):
                if mark is not None:
                    segments[-1].append(mark)
                    continue
                inner = [a, *own[bisect_right(own, a) : bisect_left(own, b)], b]
                parts.append([text[x:y] for x, y in zip(inner, inner[1:])])
                segments[-1].append(text[a:b])
        known = self.learn(list(chain.from_iterable(parts)))
        out: list[bytes | str] = []
        ends, next_part = [0], iter(parts)
        for own in segments:
            for segment in own:
                if isinstance(segment, int):
                    out.append(segment.to_bytes(4, sys.byteorder))
                else:
                    self.join(segment, [known[c] for c in next(next_part)], out)
            ends.append(len(out))
        ids = self.merged(part for part in out if isinstance(part, str))
        out = [ids[part] if isinstance(part, str) else part for part in out]
        sizes = np.concatenate(([0], np.cumsum([len(part) for part in out]))).astype(np.int64) // 4
        return np.frombuffer(b"".join(out), np.int32).astype(np.int64), sizes[ends]

    def segments(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """Stretches between special tokens, and the special tokens with their id."""
        at = 0
        for found in self.vocab.marks.finditer(text):
            if at < found.start():
                yield at, found.start(), None
            yield found.start(), found.end(), self.vocab.special[found[0]]
            at = found.end()
        if at < len(text):
            yield at, len(text), None


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Characters of each text before which a chunk ends: cuts depend on the WINDOW bytes before them alone."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))
    ends = np.flatnonzero(lead[WINDOW:]) + WINDOW if len(data) > WINDOW else np.zeros(0, np.int64)
    hashes = rolling(data.astype(np.uint64) + np.uint64(1), ends - WINDOW, ends, BYTE_BASE)
    ends = ends[hashes % np.uint64(SPACING) == 0]
    text = np.searchsorted(offsets, ends, "right") - 1
    inside = ends - WINDOW >= offsets[text]
    ends, text = ends[inside], text[inside]
    place = (before[ends] - before[offsets[text]]).tolist()
    bounds = np.searchsorted(text, np.arange(len(offsets))).tolist()
    return [place[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(2)
def encoder(body: bytes) -> Encoder:
    return Encoder(JsonVocabulary(body))


def decoded_texts(vocab: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
    raw = vocab.decode(ids).tobytes()
    ends = np.concatenate(([0], np.cumsum(vocab.lengths[ids])))[first].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


RESULT = "doc_id long, ids array<int>, decoded string"


def ids_and_texts(ids: np.ndarray, first: np.ndarray, texts: list[str]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]


def digests_of(ids: np.ndarray, first: np.ndarray, texts: list[str]) -> list[pa.Array]:
    """Number of ids, and the hashes of ids (little-endian 32-bit integers) and of the decoded text."""
    flat, ends = memoryview(ids.astype("<u4").tobytes()), (4 * first).tolist()
    return [pa.array(np.diff(first), pa.int64()), pa.array([sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
            pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string())]


def chunk_bpe(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text",
              finish: Callable[..., list[pa.Array]] = ids_and_texts, schema: str = RESULT) -> DataFrame:
    """Encode each text by the byte-level BPE file ``path`` (JSON) and decode the ids again.

    Texts are cut where the rolling hash of the bytes before says so, hence alike in all
    documents that share a passage.  A task encodes each distinct chunk once and keeps up
    to ``CACHE_CHUNKS`` of them; equality of chunks is that of their texts, never of
    hashes.  Around each join, pieces are encoded anew in the whole text until they agree
    with the chunk.  Special tokens in a text are encoded as such.  Work is row-local:
    chunks are shared within a Python worker, which costs no shuffle of texts.
    ``finish`` turns ids, their bounds and the decoded texts into the columns of
    ``schema`` behind doc_id.

    Result by default: doc_id, ids (array<int>), decoded.  One row per input row.  A null
    text counts as empty and has no ids.  Repeated and missing ids are returned as they
    are; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    body = spark.sparkContext.broadcast(read_ranks(path))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(body.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                cut = offsets[a : b + 1]
                ids, first = coder.encode(data[cut[0] : cut[-1]], cut - cut[0])
                columns = finish(ids, first, decoded_texts(coder.vocab, ids, first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)
