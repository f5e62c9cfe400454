"""Operator 12: how the tokens of two tokenizers lie over each other, and how often corpus-wide."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import read_ranks
from plumbline.llm.chunk_bpe import PIECE, JsonVocabulary
from plumbline.llm.chunks import deltas, expand, pack_table, ship, squeeze, undo
from plumbline.llm.storage import stored
from plumbline.llm.words import gather, mix, slices, utf8

SLICE = 2_000_000
CACHE_PIECES = 300_000
#: Pairs added up in a task before they are sent on; pairs asked of a bucket in one task.
PAIRS, ASKED = 2_000_000, 4_000_000
#: Distinct pairs of a bucket on average.
BUCKET = 500_000
SHIFT = np.int64(32)
#: SentencePiece's sign for a space.
SPACE = "▁"


class Pieces:
    """Numbers the distinct pieces of a side and keeps their ids, back to back."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.number = encode, {}
        self.ids, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def tokens(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as pieces, and the first id of each text."""
        if len(self.number) > CACHE_PIECES:
            self.__init__(self.encode)
        new = list(set(chain.from_iterable(texts)).difference(self.number))
        if new:
            found = self.encode(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            sizes = np.array([len(f) for f in found], np.int64)
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        counts = np.concatenate(([0], np.cumsum([len(own) for own in texts]))).astype(np.int64)
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(counts[-1]))
        each = self.ends[which + 1] - self.ends[which]
        return gather(self.ids, self.ends[which], each), np.concatenate(([0], np.cumsum(each)))[counts]


class Side:
    """A tokenizer: pieces of a text that are encoded by themselves, and the bytes of each id."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.split, self.pieces = split, Pieces(encode)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.starts[ids], self.lengths[ids])


def byte_level(body: bytes) -> Side:
    """The byte-level BPE file in JSON; special tokens are plain text."""
    vocab = JsonVocabulary(body)
    tokens = [vocab.data[a : a + n].tobytes() for a, n in zip(vocab.starts.tolist(), vocab.lengths.tolist())]
    return Side(regex.compile(PIECE).findall, lambda pieces: vocab.ids([p.encode() for p in pieces]), tokens)


def sentence_piece(body: bytes) -> Side:
    """A SentencePiece BPE model that adds a space in front and has no normalisation.

    No piece has a space behind another character, so a run of spaces with what follows
    is encoded by itself.
    """
    model = sentencepiece.SentencePieceProcessor(model_proto=body)
    names = [model.id_to_piece(k) for k in range(model.vocab_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names):
        raise ValueError("pieces that go on over a space are not supported")
    tokens = [bytes([int(name[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else name.replace(SPACE, " ").encode()
              for k, name in enumerate(names)]
    alone = model.piece_to_id(SPACE)

    def encode(pieces: list[str]) -> list[list[int]]:
        return [found or [alone] for found in model.encode([p[1:] for p in pieces], num_threads=1)]

    return Side(re.compile(" +[^ ]*").findall, encode, tokens)


@lru_cache(2)
def sides(a: bytes, b: bytes) -> tuple[Side, Side]:
    return byte_level(a), sentence_piece(b)


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions in ``ends_a`` of the byte ends that both sides share; texts begin at ``first``, and both end there.

    Divide and conquer over all texts side by side.  An interval of A's tokens ends at a
    shared end.  From its middle outwards, in stretches of doubling width, ends are sought
    in B by bisection; the nearest shared one cuts the interval in two, and both halves go
    on.  An interval without a shared end inside is a leaf: one group.
    """
    low, high = first[:-1], first[1:] - 1  # ends inside an interval are low .. high - 1
    cuts = [high[high >= low]]
    while True:
        open_ = low < high
        low, high = low[open_], high[open_]
        if not len(low):
            break
        middle, found = (low + high) >> 1, np.full(len(low), -1, np.int64)
        seeking, reach, width = np.arange(len(low)), np.zeros(len(low), np.int64), 1
        while len(seeking):
            # ends at a distance of reach .. reach + width - 1 from the middle, on both sides
            near = reach[seeking]
            right = np.minimum(middle[seeking] + near, high[seeking])
            right_end = np.minimum(right + width, high[seeking])
            left_end = np.maximum(middle[seeking] - np.maximum(near, 1) + 1, low[seeking])
            left = np.maximum(left_end - width, low[seeking])
            for start, size in ((right, right_end - right), (left, left_end - left)):
                owner = np.repeat(np.arange(len(seeking)), size)
                if not len(owner):
                    continue
                at = gather_range(start, size)
                place = np.minimum(np.searchsorted(ends_b, ends_a[at]), len(ends_b) - 1)
                hit = ends_b[place] == ends_a[at]
                owner, at = seeking[owner[hit]], at[hit]
                closer = (found[owner] < 0) | (np.abs(at - middle[owner]) < np.abs(found[owner] - middle[owner]))
                owner, at = owner[closer], at[closer]
                order = np.argsort(-np.abs(at - middle[owner]), kind="stable")
                found[owner[order]] = at[order]  # the nearest is written last
            reach[seeking] += width
            outside = (middle[seeking] - reach[seeking] < low[seeking]) & (middle[seeking] + reach[seeking] >= high[seeking])
            seeking = seeking[(found[seeking] < 0) & ~outside]
            width *= 2
        cut = found >= 0
        cuts.append(found[cut])
        # both halves, in order of the texts: neighbours seek in neighbouring places
        low, high = np.stack((low[cut], found[cut] + 1), 1).ravel(), np.stack((found[cut], high[cut]), 1).ravel()
    return np.sort(np.concatenate(cuts))


def gather_range(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers ``start .. start + size - 1`` of each pair, one range behind the other."""
    shift = starts - np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.repeat(shift, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Aligned:
    """Tokens of some texts: ids and first ids by side, groups as counts of tokens, links as pairs of ids by text."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray
    pairs: np.ndarray
    first_link: np.ndarray


def align(left: Side, right: Side, data: np.ndarray, offsets: np.ndarray) -> Aligned:
    """Encode whole texts on both sides and cut their tokens into groups."""
    raw = data.tobytes()
    texts = [" " + raw[x:y].decode() if x < y else "" for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
    a, first_a = left.pieces.tokens([left.split(t) for t in texts])
    b, first_b = right.pieces.tokens([right.split(t) for t in texts])
    wanted, bounds = utf8(pa.array(texts, pa.large_string()))
    whole = np.ones(len(texts), bool)
    for side, ids, first in ((left, a, first_a), (right, b, first_b)):
        ends = np.concatenate(([0], np.cumsum(side.lengths[ids])))[first]
        made = side.bytes(ids)
        if len(made) == len(wanted) and (ends == bounds).all() and (made == wanted).all():
            continue
        whole &= [made[p:q].tobytes() == wanted[x:y].tobytes()
                  for p, q, x, y in zip(ends.tolist(), ends[1:].tolist(), bounds.tolist(), bounds[1:].tolist())]
    if not whole.all():
        a, first_a = kept_texts(a, first_a, whole)
        b, first_b = kept_texts(b, first_b, whole)
    ends_a, ends_b = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    cuts = common_cuts(ends_a, ends_b, first_a)
    cuts_b = np.searchsorted(ends_b, ends_a[cuts])
    segments, of_a, of_b = stretches(ends_a, ends_b)
    pairs = (a[of_a] << SHIFT) | b[of_b]
    text_ends = np.concatenate(([0], ends_a))[first_a]
    return Aligned(a, b, first_a, first_b, np.diff(cuts, prepend=-1), np.diff(cuts_b, prepend=-1),
                   np.searchsorted(cuts, first_a), pairs, np.searchsorted(segments, text_ends, "right"))


def stretches(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the stretches between neighbouring ends of either side, each with the A and the B token over it: a link."""
    every = np.concatenate((ends_a, ends_b))
    if not len(every):
        return every, every, every
    order = np.argsort(every, kind="stable")
    every = every[order]
    last = np.ones(len(every), bool)
    last[:-1] = every[1:] != every[:-1]
    upto_a = np.cumsum(order < len(ends_a))[last]
    upto_b = np.flatnonzero(last) + 1 - upto_a
    return every[last], np.concatenate(([0], upto_a[:-1])), np.concatenate(([0], upto_b[:-1]))


def kept_texts(ids: np.ndarray, first: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.where(whole, np.diff(first), 0)
    return ids[np.repeat(whole, np.diff(first))], np.concatenate(([0], np.cumsum(sizes)))


@lru_cache(1)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``n``, with room for one sign behind, and how many digits each has."""
    names = [str(k).encode() for k in range(n)]
    width = len(names[-1]) + 1
    return np.array(names, f"S{width}").view(np.uint8).reshape(n, width), np.array([len(s) for s in names])


def group_texts(al: Aligned, tokens: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of each text, one behind the other, and where each ends."""
    groups = np.arange(len(al.group_a))
    of_a, of_b = np.repeat(groups, al.group_a), np.repeat(groups, al.group_b)
    upto_a, upto_b = np.cumsum(al.group_a), np.cumsum(al.group_b)
    place_a = np.arange(len(al.a)) + (upto_b - al.group_b)[of_a]
    place_b = np.arange(len(al.b)) + upto_a[of_b]
    ids = np.empty(len(al.a) + len(al.b), np.int64)
    ids[place_a], ids[place_b] = al.a, al.b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[place_a[upto_a - 1]], sign[place_b[upto_b - 1]] = ord("|"), ord(";")
    last = (al.first_a + al.first_b)[1:]
    last = last[np.diff(al.first_a) > 0] - 1
    sign[last] = 0
    digits, size = decimals(tokens)
    body = digits[ids]
    body[np.arange(len(ids)), size[ids]] = sign
    ends = np.concatenate(([0], np.cumsum(size[ids] + (sign > 0))))
    return body[body > 0].tobytes(), ends[al.first_a + al.first_b]


ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string())])
BLOCKS = "block long, n_keys long, rows binary, keys binary, uses binary"
ASKS = "bucket long, part long, block long, keys binary"
ANSWERS = "block long, bucket long, counts binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def block_of(left: Side, right: Side, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Distinct pairs of ids; rows of some texts; the pairs with their number of texts; which text uses which pair how often."""
    al = align(left, right, data, offsets)
    body, ends = group_texts(al, max(len(left.lengths), len(right.lengths)))
    view = memoryview(body)
    digests = [sha256(view[x:y]).hexdigest() if x < y else "" for x, y in zip(ends.tolist(), ends[1:].tolist())]
    sizes = [pa.array(np.diff(c), pa.int64()) for c in (al.first_a, al.first_b, al.first_group, al.first_link)]
    rows = pa.table([ids, *sizes, pa.array(digests, pa.string())], schema=ROWS)
    text = np.repeat(np.arange(len(ids)), np.diff(al.first_link))
    order = np.argsort(al.pairs, kind="stable")
    pairs, text = al.pairs[order], text[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    use = fresh.copy()
    use[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(use)
    which = np.cumsum(fresh)[at] - 1
    keys = pairs[fresh]
    return (len(keys), pack_table(rows), squeeze(deltas(keys), np.bincount(which, minlength=len(keys))),
            squeeze(deltas(which), text[at], np.diff(np.append(at, len(pairs)))))


def read_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, texts = expand(blob, 2)
    return undo(keys).astype(np.int64), texts.astype(np.int64)


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of one A id lie in one bucket."""
    return (pairs >> SHIFT) % buckets


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and their number of texts, added up over blocks of a task as far as memory allows."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, texts = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, texts = keys[order], texts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(texts, at) if len(at) else texts
        yield from pa.table({"pair": keys[at], "n": sums}).to_batches(max_chunksize=100_000)

    held, size = [], 0
    for batch in batches:
        for blob in batch.column(0):
            held.append(read_keys(blob.as_py()))
            size += len(held[-1][0])
            if size > PAIRS:
                yield from added(held)
                held, size = [], 0
    if held:
        yield from added(held)


def _asks(buckets: int, parts: int):
    """What each block asks of each bucket: its pairs there; a bucket's questions are dealt to ``parts`` tasks by block."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, _ = read_keys(blob.as_py())
                bucket = bucket_of(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                keys, bucket = keys[order], bucket[order]
                cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys)] if len(keys) else [0]
                told = [squeeze(deltas(keys[x:y])) for x, y in zip(cuts, cuts[1:])]
                part = int(mix(np.array([block], np.uint64))[0] % np.uint64(parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cuts[:-1]], pa.int64()), pa.array([part] * len(told), pa.int64()),
                    pa.array([block] * len(told), pa.int64()), pa.array(told, pa.binary()),
                ], names=["bucket", "part", "block", "keys"])

    return asks


def _answers(key: tuple[pa.Scalar, ...], asks: pa.Table, counts: pa.Table) -> pa.Table:
    """To each block, in order of its pairs in the bucket: twice the number of texts, plus one if no pair of the A id has more."""
    pairs = counts["pair"].to_numpy()
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    known = (2 * counts["n"].to_numpy() + counts["best"].to_numpy(zero_copy_only=False))[order]
    told = [squeeze(known[np.searchsorted(pairs, undo(expand(blob.as_py(), 1)[0]).astype(np.int64))]) for blob in asks["keys"]]
    return pa.table({"block": asks["block"], "bucket": asks["bucket"], "counts": pa.array(told, pa.binary())})


def _summed(buckets: int):
    """Rows of a block with what its links count corpus-wide."""

    def summed(key: tuple[pa.Scalar, ...], blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(blocks["rows"][0].as_buffer()).read_all()
        keys, _ = read_keys(blocks["keys"][0].as_py())
        bucket, known = bucket_of(keys, buckets), np.zeros(len(keys), np.int64)
        for b, blob in zip(answers["bucket"].to_pylist(), answers["counts"]):
            known[bucket == b] = expand(blob.as_py(), 1)[0].astype(np.int64)
        which, text, times = (c.astype(np.int64) for c in expand(blocks["uses"][0].as_py(), 3))
        known = known[undo(which.astype(np.uint64)).astype(np.int64)]
        order = np.argsort(text, kind="stable")
        sums = [np.concatenate(([0], np.cumsum((times * v)[order]))) for v in (known & 1, known >> 1)]
        cuts = np.searchsorted(text[order], np.arange(rows.num_rows + 1))
        for name, total in zip(("n_best", "count_sum"), sums):
            rows = rows.append_column(name, pa.array(np.diff(total[cuts]), pa.int64()))
        return rows

    return summed


def alignment(docs: DataFrame, byte_file: str, piece_file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of tokens of two tokenizers between the byte offsets at which both end, and how common their links are.

    A is the byte-level BPE file ``byte_file`` (JSON), B the SentencePiece model
    ``piece_file``; A gets a space in front of the text, as B does by itself.  A link is
    a pair of an A and a B token whose bytes overlap.  Tasks encode and align whole texts
    in blocks and keep each block's distinct pairs; Spark adds up in how many rows a pair
    is linked.  Then every block asks buckets of pairs (at most all pairs of the two
    vocabularies in number) for the counts of its own pairs; a bucket's questions are
    split over tasks, each with the bucket's counts.

    Result: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (of ``a1,a2|b1;a3|b2``),
    n_best (links whose pair no other pair of their A id outnumbers), count_sum (rows
    that hold the pair, summed over links).  One row per input row; each row is a
    document of its own, also where ids repeat or are missing.  A null or empty text, or
    one whose tokens do not give its bytes back (U+2581), has zeros and '' and links
    nothing.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    files = spark.sparkContext.broadcast((read_ranks(byte_file), read_ranks(piece_file)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(*files.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for x, y in slices(offsets, SLICE):
                cut = offsets[x : y + 1]
                made = block_of(left, right, batch.column(0).slice(x, y - x), data[cut[0] : cut[-1]], cut - cut[0])
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("block", "n_keys", "rows", "keys", "uses"), (block, *made))})
                block += 1

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(encode, BLOCKS))
    counts = blocks.select("keys").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = stored(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)))
    asked = blocks.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(1, -(-counts.count() // BUCKET))
    parts = max(1, -(-asked // (buckets * ASKED)))
    spread = counts.withColumns({"bucket": F.shiftright("pair", 32) % buckets, "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    asks = blocks.select("block", "keys").mapInArrow(_asks(buckets, parts), ASKS)
    asks, spread = asks.groupBy("bucket", "part"), spread.withColumn("part", F.col("part").cast("long")).groupBy("bucket", "part")
    answers = asks.cogroup(spread).applyInArrow(_answers, ANSWERS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed(buckets), RESULT)
