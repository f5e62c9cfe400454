"""Operator 5: byte-level BPE encoding and decoding with vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import give_back, ship
from plumbline.llm.words import BYTE_BASE, gather, rolling, slices, utf8

CACHE_PIECES = 200_000
LANES = 4096
SLICE = 500_000
LONG = 200
NEVER = 1 << 30

#: Classes of code points.  The letters of contractions are letters with a class of their own.
OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE, ONE, RV, ELL, EE, CUT = range(11)
#: States after a code point: a run of letters, numbers or others; a blank that may join what
#: follows; other white space; a quote that begins a piece, then r or v, then l; a finished
#: contraction; before a text.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_WHITE, S_QUOTE, S_RV, S_ELL, S_DONE, S_NONE = range(10)
#: The characters with the property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    for letters, kind in (("stmd", ONE), ("rv", RV), ("l", ELL), ("e", EE)):
        out[[ord(c) for c in letters]] = kind
    return out


@lru_cache(1)
def transitions() -> np.ndarray:
    """``table[class, state]`` is the next state."""
    table = np.zeros((11, 10), np.uint8)
    table[[LETTER, ONE, RV, ELL, EE]] = S_LETTER
    table[NUMBER], table[OTHER], table[BLANK], table[WHITE] = S_NUMBER, S_OTHER, S_BLANK, S_WHITE
    table[QUOTE] = S_QUOTE
    table[QUOTE, [S_BLANK, S_OTHER, S_QUOTE]] = S_OTHER
    table[ONE, S_QUOTE], table[RV, S_QUOTE], table[ELL, S_QUOTE] = S_DONE, S_RV, S_ELL
    table[EE, S_RV], table[ELL, S_ELL] = S_DONE, S_DONE
    table[CUT] = S_NONE
    return table


def states(kinds: np.ndarray) -> np.ndarray:
    """State after each code point, by an associative scan of transition functions.

    The array is cut into lanes.  Each lane composes the functions of its code points,
    all lanes side by side; the composed functions are scanned by doubling, which gives
    every lane its first state; a second walk fills in the states.
    """
    table, n = transitions(), len(kinds)
    steps = max(1, -(-n // LANES))
    lanes = max(1, -(-n // steps))
    grid = np.full(lanes * steps, CUT, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    whole = np.tile(np.arange(10, dtype=np.uint8), (lanes, 1))
    for row in grid:
        whole = table[row[:, None], whole]
    reach = 1
    while reach < lanes:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), axis=1)
        reach *= 2
    state = np.full(lanes, S_NONE, np.uint8)
    state[1:] = whole[:-1, S_NONE]
    out = np.empty((steps, lanes), np.uint8)
    for k, row in enumerate(grid):
        state = table[row, state]
        out[k] = state
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; texts are parted by ``CUT``, at which one seems to begin."""
    now = states(kinds)
    letter = (kinds == LETTER) | ((kinds >= ONE) & (kinds <= EE))
    before = np.append(np.uint8(S_NONE), now[:-1])
    after = np.append(now[1:], np.uint8(S_NONE))
    white = (kinds == BLANK) | (kinds == WHITE)
    follows = np.append(kinds[1:], np.uint8(CUT))
    last_white = white & (follows != BLANK) & (follows != WHITE) & (follows != CUT)
    was_white = np.append(False, white[:-1])
    starts = white & (~was_white | last_white)
    fresh = ~((before == S_LETTER) | (before == S_BLANK) | (before == S_RV) | (before == S_ELL))
    pending = (now == S_RV) | (now == S_ELL)
    starts |= letter & (now == S_LETTER) & fresh
    starts |= letter & pending & (after != S_DONE)
    starts |= (now == S_NUMBER) & (before != S_NUMBER) & (before != S_BLANK)
    starts |= (now == S_OTHER) & (before != S_OTHER) & (before != S_BLANK) & (before != S_QUOTE)
    starts |= now == S_QUOTE
    return starts | (kinds == CUT)


class Vocabulary:
    """Ranks of a tiktoken file and the pieces merged so far."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        splits = [(self.ranks[t[:i]] * len(tokens) + self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs, self.made = (np.array(c, np.int64) for c in zip(*sorted(splits)))
        self.cache: dict[bytes, bytes] = {}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, ``NEVER`` where there is none."""
        key = left * len(self.lengths) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NEVER)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """One piece, by a heap of its adjacent pairs."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i, r in enumerate(self.ranked(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r < NEVER]
        heapify(heap)
        gone = [False] * n
        now = {(i, j): rank for rank, i, j in heap}
        while heap:
            rank, i, j = heappop(heap)
            if gone[i] or gone[j] or after[i] != j or now.get((i, j)) != rank:
                continue
            ids[i], gone[j], after[i] = rank, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    now[a, b] = int(self.ranked(np.array([ids[a]]), np.array([ids[b]]))[0])
                    if now[a, b] < NEVER:
                        heappush(heap, (now[a, b], a, b))
        return tuple(t for t, dead in zip(ids, gone) if not dead)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Join, piece by piece, the adjacent parts whose union has the lowest rank, until none is left.

        All pieces take each step together; pieces that are done leave.
        """
        out = [self.merge_long(p) if len(p) > LONG else () for p in pieces]
        number = np.array([k for k, p in enumerate(pieces) if len(p) <= LONG], np.int64)
        if not len(number):
            return out
        n = np.array([len(pieces[k]) for k in number])
        token = self.bytes[np.frombuffer(b"".join(pieces[k] for k in number), np.uint8)]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        rank = np.append(self.ranked(token[:-1], token[1:]), NEVER)
        rank[first[1:] - 1] = NEVER
        while len(number):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
            low, at = best >> 32, best & 0xFFFFFFFF
            done = low == NEVER
            for k, a, size in zip(number[done].tolist(), first[done].tolist(), n[done].tolist()):
                out[k] = tuple(token[a : a + size].tolist())
            keep = np.repeat(~done, n)
            at, low = at[~done], low[~done]
            token[at] = low
            end = (first + n)[~done]
            keep[at + 1] = False
            step = np.cumsum(keep) - 1
            following = at + 2 < end
            rank[at] = NEVER
            rank[at[following]] = self.ranked(token[at[following]], token[at[following] + 2])
            leading = at > first[~done]
            rank[at[leading] - 1] = self.ranked(token[at[leading] - 1], token[at[leading]])
            token, rank = token[keep], rank[keep]
            number, n = number[~done], n[~done] - 1
            first = step[first[~done]] if len(number) else first[:0]
        return out

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as 32-bit integers; the cache holds them so, which takes a third of the memory of tuples."""
        found = [self.cache.get(p) for p in pieces]
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
        merged = self.merge(new)
        ends = list(accumulate((4 * len(ids) for ids in merged), initial=0))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, ends[-1] // 4).tobytes()
        made = {p: flat[a:b] for p, a, b in zip(new, ends, ends[1:])}
        self.cache.update(islice(made.items(), CACHE_PIECES))
        return [made[p] if ids is None else ids for p, ids in zip(pieces, found)]

    def ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(memoryview(ids).cast("i")) for ids in self.packed(pieces)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.starts[ids], self.lengths[ids])


@lru_cache(2)
def vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


def unlike(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Pieces that differ from the piece of number ``like``; the pieces make up ``data``, one behind the other."""
    if not len(begins):
        return begins
    size = ends - begins
    other = size != size[like]
    shown = gather(data, np.where(other, begins, begins[like]), size)
    return np.flatnonzero(other | np.logical_or.reduceat(shown != data, begins))


def encode(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, first id of each text, and byte offset in its text of each id's piece."""
    lead = (data & 0xC0) != 0x80
    points = np.flatnonzero(lead)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.searchsorted(points, offsets[:-1])
    kinds = np.insert(classes()[code], first, CUT)
    starts = piece_starts(kinds)
    real = kinds != CUT
    starts[1:] |= ~real[:-1]
    begins = points[starts[real]]
    ends = np.append(begins[1:], len(data))
    hashes = rolling(data.astype(np.uint64) + np.uint64(1), begins, ends, BYTE_BASE)
    _, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(begins[sample].tolist(), ends[sample].tolist())]
    others: dict[bytes, int] = {}
    for k in unlike(data, begins, ends, sample[place]).tolist():
        place[k] = others.setdefault(raw[begins[k] : ends[k]], len(pieces) + len(others))
    merged = vocab.packed([*pieces, *others])
    lengths = np.array([len(m) // 4 for m in merged], np.int64)
    flat = np.frombuffer(b"".join(merged), np.int32).astype(np.int64)
    where = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    each = lengths[place]
    ids = gather(flat, where[place], each)
    ends_of = np.concatenate(([0], np.cumsum(each)))
    piece_of_text = np.searchsorted(begins, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(piece_of_text))
    return ids, ends_of[piece_of_text], np.repeat(begins - offsets[text], each)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


TOKENS = "doc_id long, ids array<int>, offsets array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokens(ids: np.ndarray, first: np.ndarray, at: np.ndarray, decoded: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    lists = pa.array(first, pa.int32())
    return [
        pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(at, pa.int32())),
        pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(decoded)]),
    ]


def digests(ids: np.ndarray, first: np.ndarray, at: np.ndarray, decoded: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Number of ids, and the hashes of ids (little-endian 32-bit integers) and of decoded bytes."""
    flat, text = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes())
    spans = lambda view, ends, w: [sha256(view[w * a : w * b]).hexdigest() for a, b in zip(ends, ends[1:])]
    return [pa.array(np.diff(first), pa.int64()), pa.array(spans(flat, first.tolist(), 4), pa.string()),
            pa.array(spans(text, bounds.tolist(), 1), pa.string())]


def bpe(docs: DataFrame, ranks: str, id: str = "doc_id", text: str = "text",
        finish: Callable[..., list[pa.Array]] = tokens, schema: str = TOKENS) -> DataFrame:
    """Encode each text by the ranks in the file ``ranks`` and decode it again.

    Pieces are those of the pattern of the byte-level rank files.  Their boundaries come
    from a scan of state transitions over classes of code points; equal pieces of a batch
    are merged once, and a worker keeps up to ``CACHE_PIECES`` merged pieces.  ``finish``
    turns ids, their bounds, offsets, decoded bytes and their bounds of some whole texts
    into the columns of ``schema`` behind doc_id.

    Result by default: doc_id, ids (array<int>), offsets (byte in the text at which each
    id's piece begins) and decoded (binary, equal to the text's UTF-8).  One row per input
    row.  A null text counts as empty and has no ids.  Repeated and missing ids are
    returned as they are; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    lines = spark.sparkContext.broadcast(read_ranks(ranks))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(lines.value)
        give_back()  # what building it took, and what stages before left in this worker
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                cut = offsets[a : b + 1]
                ids, first, at = encode(vocab, data[cut[0] : cut[-1]], cut - cut[0])
                bounds = np.concatenate(([0], np.cumsum(vocab.lengths[ids])))[first]
                columns = finish(ids, first, at, vocab.decode(ids), bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)
                del ids, first, at, bounds, columns
            del data, offsets
            give_back()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)
