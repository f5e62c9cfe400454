"""Interpolated modified Kneser-Ney models over bytes, counted and asked in shards.

Texts lie in chunks.  Every chunk sends the n-grams of its labelled texts, with counts
by class, to shards; a shard is chosen by the two bytes before the last one, so it holds
every n-gram of order three and more, and every context, that a query of the shard can
need.  Orders one and two have at most 65,792 entries and go to all shards.  Chunks then
send their distinct n-grams, and the shards answer with log-probabilities, or with the
log-ratio of two classes.

Orders three to six count by class: the highest its occurrences, the others how many
bytes the class has seen before them.  Orders one and two are continuation counts that
all classes share, so a rare expression backs off to the same ground in each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import dealt, deltas, expand, lean, sizes, squeeze, undo, unpack_tables
from plumbline.llm.words import LOWER, slices, utf8

ORDER = 6
CHUNK_FACTOR = 4
SLICE = 1_000_000
MERGED = "bucket long, kind int, key int, n1 long, n2 long, n3 long, n4 long, counted binary"
STATS = "array<struct<kind:int,key:int,n1:long,n2:long,n3:long,n4:long>>"


def grams(data: np.ndarray, offsets: np.ndarray, lower: bool) -> np.ndarray:
    """One n-gram per byte, packed into an integer, the byte itself lowest; zeros stand before a text."""
    n, texts = np.diff(offsets), len(offsets) - 1
    room = np.zeros(len(data) + (ORDER - 1) * texts, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, texts + 1) * (ORDER - 1), n)
    room[at] = LOWER[data] if lower else data
    packed = np.zeros(len(room), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        packed <<= np.uint64(8)
        packed[back:] |= room[: len(room) - back]
    return packed[at]


class Table:
    """A direct-mapped table of n-grams and values: a slot holds the last that was put there."""

    BITS = 20

    def __init__(self):
        self.gram = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.zeros(1 << self.BITS, np.float32)

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def absent(self, gram: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.gram[self.slot(gram)] != gram)

    def put(self, gram: np.ndarray, value: np.ndarray | None = None) -> None:
        slot = self.slot(gram)
        self.gram[slot] = gram
        if value is not None:
            self.value[slot] = value


def shard(gram: np.ndarray, buckets: int) -> np.ndarray:
    middle = (gram >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((middle * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)


def _by_shard(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Order of sorted n-grams by shard, the shards that occur, and where each begins and the last ends."""
    part = shard(gram, buckets)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1)) if len(part) else np.zeros(0, np.int64)
    return order, part[cuts].astype(np.int64).tolist(), [*cuts.tolist(), len(part)]


def _distinct(table: pa.Table, lower: bool) -> np.ndarray:
    data, offsets = utf8(table["text"])
    seen, found = Table(), [np.zeros(0, np.uint64)]
    for a, b in slices(offsets, SLICE):
        cut = offsets[a : b + 1]
        gram = grams(data[cut[0] : cut[-1]], cut - cut[0], lower)
        found.append(np.unique(gram[seen.absent(gram)]))
        seen.put(found[-1])
    return np.unique(np.concatenate(found))


def _summed(parts: list[list[np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of several counts, each once and sorted, with the sums of their counts."""
    gram = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    gram, place = np.unique(gram, return_inverse=True)
    counts = np.zeros((classes, len(gram)), np.int64)
    for c in range(classes):
        if parts:
            given = np.concatenate([p[1 + c] for p in parts]).astype(np.float64)
            counts[c] = np.bincount(place, given, len(gram)).astype(np.int64)
    return gram, counts


def _counted(buckets: int, classes: int, lower: bool):
    """Counts of the labelled texts of a chunk, by shard."""

    def counted(key: tuple[pa.Scalar, ...], packs: pa.Table, labels: pa.Table) -> pa.Table:
        rows = {"bucket": [], "counted": []}
        table = unpack_tables(packs["pack"])
        if table is not None and labels.num_rows:
            known = dict(zip(labels["id"].to_pylist(), labels["label"].to_pylist()))
            label = np.array([known.get(i, -1) for i in table["id"].to_pylist()], np.int64)
            parts = []
            for c in range(classes):
                data, offsets = utf8(table.filter(pa.array(label == c))["text"])
                for a, b in slices(offsets, SLICE):
                    cut = offsets[a : b + 1]
                    gram, n = np.unique(grams(data[cut[0] : cut[-1]], cut - cut[0], lower), return_counts=True)
                    zero = np.zeros(len(gram), np.int64)
                    parts.append([gram, *[n if k == c else zero for k in range(classes)]])
            gram, counts = _summed(parts, classes)
            order, rows["bucket"], cuts = _by_shard(gram, buckets)
            for a, b in zip(cuts, cuts[1:]):
                rows["counted"].append(squeeze(deltas(gram[order[a:b]]), *[n[order[a:b]] for n in counts]))
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), "counted": pa.array(rows["counted"], pa.binary())})

    return counted


def _read(blobs: pa.ChunkedArray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [expand(b.as_py(), 1 + classes) for b in blobs]
    return _summed([[undo(p[0]), *p[1:]] for p in parts], classes)


def _suffixes(gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of sorted distinct longer n-grams, with the number of bytes seen before each."""
    return np.unique(gram & np.uint64((1 << 8 * order) - 1), return_counts=True)


def _levels(gram: np.ndarray, n: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Order, n-grams and counts of one class, from order six down to three."""
    levels = [(ORDER, gram, n)]
    for order in range(ORDER - 1, 2, -1):
        gram, n = _suffixes(gram, order)
        levels.append((order, gram, n))
    return levels


def _merged(classes: int):
    """One count for a shard, and what the discounts need: how many n-grams have count 1, 2, 3 and 4."""

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gram, counts = _read(table["counted"], classes)
        rows = [(0, 0, 0, 0, 0, 0, squeeze(deltas(gram), *counts))]
        few = lambda n: [int((n == k).sum()) for k in (1, 2, 3, 4)]
        for c in range(classes):
            for order, _, n in _levels(gram[counts[c] > 0], counts[c][counts[c] > 0]):
                rows.append((10 * order + c, 0, *few(n), None))
        pair, n = _suffixes(_suffixes(gram, 3)[0], 2)
        rows += [(20, int(p), int(k), 0, 0, 0, None) for p, k in zip(pair, n)]
        columns = list(zip(*rows))
        return pa.table({
            "bucket": np.full(len(rows), key[0].as_py(), np.int64),
            "kind": pa.array(columns[0], pa.int32()), "key": pa.array(columns[1], pa.int32()),
            **{f"n{k}": pa.array(columns[1 + k], pa.int64()) for k in (1, 2, 3, 4)},
            "counted": pa.array(columns[6], pa.binary()),
        })

    return merged


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; halves where counts of counts are missing."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0.0, 0.05, 0.05, 0.05], [0.0, 0.95, 1.9, 2.85])


def interpolated(query: np.ndarray, lower: np.ndarray, gram: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probability of ``query`` n-grams from sorted n-grams, their counts and the next lower order's probability."""
    if not len(gram):
        return lower
    context, first = np.unique(gram >> np.uint64(8), return_index=True)
    cut = d[np.minimum(n, 3)]
    total, spare = np.add.reduceat(n, first), np.add.reduceat(cut, first)
    at = np.minimum(np.searchsorted(context, query >> np.uint64(8)), len(context) - 1)
    known = context[at] == query >> np.uint64(8)
    hit = np.minimum(np.searchsorted(gram, query), len(gram) - 1)
    own = np.where(gram[hit] == query, n[hit] - cut[hit], 0.0)
    return np.where(known, (own + spare[at] * lower) / total[at], lower)


class Shard:
    """The counts of one shard with the corpus-wide discounts and the counts of orders one and two."""

    def __init__(self, gram: np.ndarray, counts: np.ndarray, stats: list[dict]):
        found = {s["kind"]: discounts(s["n1"], s["n2"], s["n3"], s["n4"]) for s in stats if s["kind"] != 20}
        pairs = sorted((s["key"], s["n1"]) for s in stats if s["kind"] == 20)
        pair, n = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        half = np.array([0.0, 0.5, 0.5, 0.5])
        few = lambda n: [int((n == k).sum()) for k in (1, 2, 3, 4)]
        one, ones = np.unique(pair & 255, return_counts=True)
        self.shared = [(1, one.astype(np.uint64), ones, discounts(*few(ones))), (2, pair.astype(np.uint64), n, discounts(*few(n)))]
        self.own = [
            [(order, g, n, found.get(10 * order + c, half)) for order, g, n in _levels(gram[m > 0], m[m > 0])[::-1]]
            for c, m in enumerate(counts)
        ]

    def log_probabilities(self, query: np.ndarray) -> np.ndarray:
        """A row per class."""
        def through(p: np.ndarray, levels: list) -> np.ndarray:
            for order, gram, n, d in levels:
                p = interpolated(query & np.uint64((1 << 8 * order) - 1), p, gram, n, d)
            return p

        p = through(np.full(len(query), 1 / 256), self.shared)
        return np.log(np.stack([through(p, levels) for levels in self.own]))


def _answers(classes: int):
    """Per chunk of a shard's queries: the log-probabilities, or the log-ratio of class 1 to class 0."""

    def answers(key: tuple[pa.Scalar, ...], model: pa.Table, asked: pa.Table) -> pa.Table:
        blobs, stats = model["counted"].drop_null(), []
        for given in model["stats"]:
            stats += given.as_py() or []
        shard = Shard(*_read(blobs, classes), stats)
        told = []
        for blob in asked["asked"]:
            found = shard.log_probabilities(undo(expand(blob.as_py(), 1)[0]))
            told.append((found[1] - found[0] if classes == 2 else found[0]).astype(np.float16).tobytes())
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "told": pa.array(told, pa.binary())})

    return answers


def scored(docs: DataFrame, labels: DataFrame, classes: int, measure: Callable, schema: str,
           id: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """Train on the labelled texts and measure every text by the model.

    ``labels`` has id and label (0 up to ``classes`` - 1) once per id.  ``measure`` gets
    bytes, offsets and one value per byte of some whole texts and returns a dict of
    columns, which with ``id`` makes the rows of ``schema``.
    """
    size = sizes(docs, text)
    chunks = max(1, -(-size.chunks // CHUNK_FACTOR))
    buckets = max(8, -(-chunks // 2))
    packs = dealt(docs, id, text, chunks)
    none: Column = F.lit(None)
    chunk = F.pmod(F.xxhash64(none.cast("string"), F.col("id")), F.lit(chunks))
    known = labels.where("id is not null").select(chunk.alias("chunk"), "id", "label")

    def asked(key: tuple[pa.Scalar, ...], packed: pa.Table) -> pa.Table:
        gram = _distinct(unpack_tables(packed["pack"]), lower)
        order, part, cuts = _by_shard(gram, buckets)
        blobs = [squeeze(deltas(gram[order[a:b]])) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"bucket": pa.array(part, pa.int64()), "chunk": np.full(len(part), key[0].as_py(), np.int64),
                         "asked": pa.array(blobs, pa.binary())})

    def measured(key: tuple[pa.Scalar, ...], packed: pa.Table, told: pa.Table) -> pa.Table:
        table = unpack_tables(packed["pack"])
        names = [c.split()[0] for c in schema.split(",")]
        if table is None:
            return pa.table({n: pa.array([], pa.float64() if n != "id" else pa.int64()) for n in names})
        gram = _distinct(table, lower)
        order, part, cuts = _by_shard(gram, buckets)
        value = np.zeros(len(gram), np.float32)
        given = dict(zip(told["bucket"].to_pylist(), told["told"]))
        for bucket, a, b in zip(part, cuts, cuts[1:]):
            value[order[a:b]] = np.frombuffer(given[bucket].as_py(), np.float16)
        data, offsets = utf8(table["text"])
        parts, cache = [], Table()
        cache.put(gram, value)
        for a, b in slices(offsets, SLICE):
            cut = offsets[a : b + 1]
            piece, cut = data[cut[0] : cut[-1]], cut - cut[0]
            own = grams(piece, cut, lower)
            each, rest = cache.value[cache.slot(own)], cache.absent(own)
            each[rest] = value[np.searchsorted(gram, own[rest])]
            parts.append(pa.table({"id": table["id"].slice(a, b - a), **measure(piece, cut, each)}))
        return pa.concat_tables(parts).select(names)

    counted = packs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        lean(_counted(buckets, classes, lower)), "bucket long, counted binary")
    merged = counted.groupBy("bucket").applyInArrow(lean(_merged(classes)), MERGED)
    numbers = [F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4)]
    stats = merged.where("kind > 0").groupBy("kind", "key").agg(*numbers)
    stats = stats.agg(F.collect_list(F.struct("kind", "key", "n1", "n2", "n3", "n4")).alias("stats"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket")
    model = merged.where("kind = 0").select("bucket", "counted", none.cast(STATS).alias("stats")).unionByName(
        stats.select(everywhere, none.cast("binary").alias("counted"), F.col("stats").cast(STATS).alias("stats")))
    queries = packs.groupBy("chunk").applyInArrow(lean(asked), "bucket long, chunk long, asked binary")
    told = model.groupBy("bucket").cogroup(queries.groupBy("bucket")).applyInArrow(
        lean(_answers(classes)), "chunk long, bucket long, told binary")
    return packs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lean(measured), schema)
