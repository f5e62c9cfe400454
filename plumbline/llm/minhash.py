"""Operator 3: near-duplicate documents by an inverted join over MinHash coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import bucket_cuts, dealt, deltas, expand, give_back, lean, ship, sizes, squeeze, undo, unpack_tables
from plumbline.llm.storage import components, stored
from plumbline.llm.words import mix, shingles, slices, split, utf8


BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Near:
    """Shingles of ``width`` words; links need a Jaccard similarity of ``percent`` / 100 or more.

    The value of a coordinate is a hash of two MinHash values, so two sets agree on it
    with the square of their similarity: documents that share passages with several
    others collide on far fewer coordinates than near copies do.  A pair is looked at if
    at least ``matches`` of ``coordinates`` values agree.  At similarity 0.8 the count is
    binomial (48, 0.64): fewer than 17 agree for about 2 of a hundred thousand pairs,
    and more similar pairs are missed less.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 48
    matches: int = 17
    seed: int = 7
    block: int = 256


def _multipliers(near: Near) -> np.ndarray:
    """Two odd multipliers per coordinate."""
    odd = mix(np.arange(1, 2 * near.coordinates + 1, dtype=np.uint64) + np.uint64(near.seed * 1_000_003)) | np.uint64(1)
    return odd.reshape(-1, 2)


def _text_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of texts: first row, rows, bounds of each text's shingles, and the sorted shingle hashes."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        cut = offsets[a : b + 1]
        text, found = shingles(split(data[cut[0] : cut[-1]], cut - cut[0]), width)
        yield a, b - a, np.searchsorted(text, np.arange(b - a + 1)), found


def signatures(docs: DataFrame, id: str, text: str, near: Near) -> DataFrame:
    """id, n (distinct shingles), two hashes of the set, and its MinHash values (none for an empty set)."""
    ship(docs.sparkSession)
    multipliers = _multipliers(near)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, rows, bounds, found in _text_sets(batch.column(1), near.width):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                at = bounds[:-1][full]
                sums = np.zeros((2, rows), np.uint64)
                values = np.zeros((len(full), near.coordinates), np.uint32)
                if len(full):
                    sums[0, full] = np.add.reduceat(found, at)
                    sums[1, full] = np.add.reduceat(mix(found), at)
                    for k, (m, other) in enumerate(multipliers):
                        least = np.minimum.reduceat(found * m, at) * other + np.minimum.reduceat(found * other, at)
                        values[:, k] = mix(least) >> np.uint64(32)
                lists = np.concatenate(([0], np.cumsum((n > 0) * near.coordinates))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, rows), pa.array(n, pa.int64()),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(values.reshape(-1).view(np.int32))),
                ], names=["id", "n", "h1", "h2", "signature"])
        give_back()

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        sign, "id long, n long, h1 long, h2 long, signature array<int>"
    )


def _looked_at(docs: DataFrame, id: str, text: str, wanted: DataFrame, near: Near) -> DataFrame:
    """rep, n, common, keys and packed set of the wanted documents that can have a partner among them.

    Only the texts of wanted ids are dealt into chunks.  Up to ``BROADCAST_IDS`` ids (some
    tens of MB as a hash table) go to every task, so that no other text moves; more are
    joined by a shuffle.

    Two similar sets share one of their ``n - ceil(n * percent / 100) + 1`` rarest shingles,
    whatever the common order of rarity.  Chunks send their shingles with counts to buckets
    of the hash space and get each one's frequency back, so a text that owes its equal
    MinHash values to a passage of many documents finds its own shingles alone and drops out.
    Buckets also number the shingles that two or more wanted documents have; keys and packed
    sets are such numbers, a third of the hashes in bytes.  Shingles that no other wanted
    document has cannot be in an overlap: they are left out of the packed sets and count in
    ``n`` alone.  ``common`` counts the others: no overlap is larger.
    """
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("rep").alias("_wanted"))
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    docs = docs.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("_wanted"), "left_semi")
    size = sizes(docs, "text")
    chunk = F.pmod(F.xxhash64(F.lit(None).cast("string"), F.col("rep")), F.lit(size.chunks))
    none = F.lit(None)
    rows = dealt(docs, "id", "text", size.chunks).select(
        "chunk", "pack", none.cast("long").alias("rep"), none.cast("long").alias("h1")
    ).unionByName(wanted.select(chunk.alias("chunk"), none.cast("binary").alias("pack"), "rep", "h1"))
    percent, width, buckets = near.percent, near.width, size.buckets

    def sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Representatives of a chunk, bounds of their sets, and the sets, one behind the other."""
        asked = table.filter(table["rep"].is_valid())
        want = dict(zip(asked["rep"].to_pylist(), asked["h1"].to_pylist()))
        texts = unpack_tables(table["pack"].drop_null())
        reps, found, ends = [], [np.zeros(0, np.uint64)], [0]
        if texts is not None and want:
            texts = texts.filter(pc.is_in(texts["id"], asked["rep"].combine_chunks()))
            ids = texts["id"].to_pylist()
            for begin, n, bounds, hashes in _text_sets(texts["text"], width):
                for row in range(n):
                    one, rep = hashes[bounds[row] : bounds[row + 1]], ids[begin + row]
                    if len(one) and int(one.sum(dtype=np.uint64).view(np.int64)) == want.get(rep):
                        del want[rep]
                        reps.append(rep)
                        found.append(one)
                        ends.append(ends[-1] + len(one))
        return np.array(reps, np.int64), np.array(ends), np.concatenate(found)

    def shares(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, counts = np.unique(sets(table)[2], return_counts=True)
        bucket, cuts = bucket_cuts(hashes, buckets)
        blobs = [squeeze(deltas(hashes[a:b]), counts[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"bucket": bucket, "chunk": np.full(len(bucket), key[0].as_py(), np.int64),
                         "counted": pa.array(blobs, pa.binary())})

    def answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = [expand(blob.as_py(), 2) for blob in table["counted"]]
        hashes = np.concatenate([undo(h) for h, _ in read])
        _, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in read]).astype(np.float64))
        total = np.minimum(total, 255).astype(np.uint64)
        number = np.maximum(np.cumsum(total > 1) - 1, 0)
        ends = np.cumsum([len(h) for h, _ in read])
        asked = [place[e - len(h) : e] for e, (h, _) in zip(ends, read)]
        blobs = [squeeze(total[p], deltas(number[p])) for p in asked]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "numbered": pa.array(blobs, pa.binary())})

    def keyed(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        reps, ends, found = sets(table)
        n = np.diff(ends)
        _, place = np.unique(found, return_inverse=True)
        told = told.sort_by("bucket")
        read = [expand(blob.as_py(), 2) for blob in told["numbered"]]
        nothing = np.zeros(0, np.uint64)
        df = np.concatenate([nothing, *[frequency for frequency, _ in read]])[place]
        # numbers of all buckets lie between each other, so that those of a set are dense
        found = np.concatenate([nothing, *[
            undo(number) * np.uint64(buckets) + np.uint64(bucket)
            for bucket, (_, number) in zip(told["bucket"].to_pylist(), read)
        ]])[place]
        row = np.repeat(np.arange(len(reps)), n)
        order = np.lexsort((found, df, row))
        rank = np.arange(len(found)) - ends[:-1][row]
        needed = n - (n * percent + 99) // 100 + 1
        picked = order[(rank < needed[row]) & (df[order] > 1)]
        bounds = np.searchsorted(row[picked], np.arange(len(reps) + 1))
        alive = np.flatnonzero(np.diff(bounds))
        keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found[picked].view(np.int64)))
        shared = df > 1
        common = np.bincount(row, shared, len(reps)).astype(np.int64)
        held = [slice(ends[i], ends[i + 1]) for i in alive]
        return pa.table({"rep": reps[alive], "n": n[alive], "common": common[alive], "keys": keys.take(pa.array(alive)),
                         "shingles": pa.array([squeeze(deltas(np.sort(found[h][shared[h]]))) for h in held], pa.binary())})

    shared = rows.groupBy("chunk").applyInArrow(lean(shares), "bucket long, chunk long, counted binary")
    told = shared.groupBy("bucket").applyInArrow(lean(answers), "chunk long, bucket long, numbered binary")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        lean(keyed), "rep long, n long, common long, keys array<long>, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) with enough equal MinHash values whose full sets are similar enough."""
    side = lambda s, *cs: sets.select(F.col("rep").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cs])
    signed = pairs.join(side("a", "signature"), "a").join(side("b", "signature"), "b")
    equal = F.zip_with("a_signature", "b_signature", lambda x, y: (x == y).cast("int"))
    agree = F.aggregate(equal, F.lit(0), lambda n, x: n + x) >= near.matches
    rows = signed.where(agree).select("a", "b").join(side("a", "n", "shingles"), "a").join(side("b", "n", "shingles"), "b")
    rows = rows.select("a", "b", "a_shingles", "b_shingles", (F.col("a_n") + F.col("b_n")).alias("n"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, first = [], None, None
            for row in range(batch.num_rows):
                if (a := batch.column(0)[row].as_py()) != last:
                    last, first = a, undo(expand(batch.column(2)[row].as_py(), 1)[0])
                second = undo(expand(batch.column(3)[row].as_py(), 1)[0])
                both = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * both >= near.percent * (batch.column(4)[row].as_py() - both):
                    good.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())),
                                              batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def _tiled(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links between the members outside a list's largest component and all others, tile by tile.

    Tiles hold ``block`` rows a side; a row goes to the tiles of its line or column.
    Each row gets one link to every component of a tile that it reaches.
    """
    rows = members.select("value", "members", "others", "label", "largest", "me.rep", "me.n")
    rows = rows.join(sets.select("rep", "signature", "shingles"), "rep")
    tiles = lambda n: F.ceil(F.col(n) / near.block)
    own = lambda n: F.pmod(F.xxhash64("rep"), tiles(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (tiles(n) - 1).cast("long")))
    row = ["rep", "n", "label", "signature", "shingles"]
    few = rows.where("label <> largest").select(own("others").alias("i"), every("members").alias("j"), "value", *row)
    again = [F.col(c).alias(c) for c in ("value", *row)]
    all_ = rows.select(every("others").alias("i"), own("members").alias("j"), *again)

    def link(key: tuple[pa.Scalar, ...], few: pa.Table, all_: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if few.num_rows and all_.num_rows:
            unpacked = lambda t: [undo(expand(b.as_py(), 1)[0]) for b in t["shingles"]]
            signed = lambda t: np.array(t["signature"].to_pylist(), np.int32)
            left, right = unpacked(few), unpacked(all_)
            n = all_["n"].to_numpy()
            words, codes = np.unique(np.concatenate(right), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum([len(r) for r in right])[:-1]))
            s, t, labels, reps = signed(few), signed(all_), all_["label"].to_numpy(), all_["rep"].to_numpy()
            lines = zip(left, few["n"].to_pylist(), few["rep"].to_pylist(), few["label"].to_pylist())
            for x, (one, size, rep, label) in enumerate(lines):
                held = np.zeros(len(words), np.int32)
                held[np.searchsorted(words, one[np.isin(one, words, assume_unique=True)])] = 1
                both = np.add.reduceat(held[codes], starts)
                good = (100 * both >= near.percent * (size + n - both)) & (labels != label)
                good = np.flatnonzero(good & ((s[x] == t).sum(axis=1) >= near.matches))
                _, first = np.unique(labels[good], return_index=True)
                found += [(min(rep, int(y)), max(rep, int(y))) for y in reps[good[first]]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    tile = ("value", "i", "j")
    return few.groupBy(*tile).cogroup(all_.groupBy(*tile)).applyInArrow(lean(link), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """Link documents whose sets of shingles are similar, and name each component by its smallest id.

    Documents with equal sets form a class, which its smallest id represents.  Each
    representative is posted under its coordinate-value pairs; collisions are counted,
    and only representatives with ``matches`` shared values stay.  Merging skips all
    shingles but the prefix of rare ones that two similar sets must share, and those
    are the lists that pairs come from.  Members of a list are first held against its
    member with the fewest shingles of its own; what that links is one component and needs no more looking at.
    Members outside the list's largest component are then held against all members of
    other components, in lists over ``block`` members tile by tile.  Every pair held counts its equal MinHash values, and is confirmed
    on full sets if enough agree.  So no link between components is lost, and a group of
    near copies costs one pair per copy.

    Result: doc_id, n_shingles, component_id and kept (doc_id = component_id).  One row
    per distinct id; of rows that repeat an id, the one with the largest set (ties: the
    larger hashes) counts.  Null and empty texts have no shingles and are linked with
    nothing; rows without id are returned each, with a null component, and kept.  An
    empty table gives no rows; other columns are ignored.
    """
    raw = stored(signatures(docs, id, text, near))
    one = raw.where("id is not null").groupBy("id").agg(F.max(F.struct("n", "h1", "h2", "signature")).alias("s"))
    texts = stored(one.select("id", "s.*"))
    key = ["n", "h1", "h2"]
    classes = stored(texts.where("n > 0").groupBy(*key).agg(
        F.min("id").alias("rep"), F.any_value("signature").alias("signature")))

    value = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = classes.select("rep", F.posexplode("signature").alias("k", "v")).select("rep", value.alias("value"))
    shared = posted.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value")
    collided = posted.join(shared, "value").groupBy("rep").count().where(F.col("count") >= near.matches)
    wanted = stored(classes.join(collided.select("rep"), "rep", "left_semi").select("rep", "h1", "signature"))
    sets = stored(_looked_at(docs, id, text, wanted, near).join(wanted.select("rep", "signature"), "rep"))
    me = F.struct("rep", "n", "common")
    postings = sets.select(me.alias("me"), F.explode("keys").alias("value"))

    def possible(x: str, y: str) -> Column:
        overlap = F.least(F.col(f"{x}.common"), F.col(f"{y}.common"))
        return overlap * 100 >= (F.col(f"{x}.n") + F.col(f"{y}.n") - overlap) * near.percent

    own = (F.col("me.n") - F.col("me.common")) / F.col("me.n")
    purest = postings.groupBy("value").agg(F.min(F.struct(own.alias("own"), "me")).alias("least"))
    first = postings.join(purest.select("value", F.col("least.me").alias("pivot")), "value")
    first = first.where("pivot.rep <> me.rep").where(possible("pivot", "me"))
    first = first.select(F.least("pivot.rep", "me.rep").alias("a"), F.greatest("pivot.rep", "me.rep").alias("b"))
    links = stored(_confirmed(first.distinct(), sets, near))
    label = components(links, "a", "b")
    placed = stored(postings.join(label, F.col("me.rep") == F.col("node"), "left").select(
        "value", "me", F.coalesce("label", "me.rep").alias("label")))
    groups = placed.groupBy("value", "label").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("value").agg(
        F.count("*").alias("labels"), F.sum("n").alias("members"), F.max("n").alias("most"),
        F.max_by("label", F.struct("n", "label")).alias("largest"))
    mixed = mixed.where("labels > 1").select("value", "members", (F.col("members") - F.col("most")).alias("others"), "largest")
    open_ = stored(placed.join(mixed, "value"))
    short, long_ = open_.where(F.col("members") <= near.block), open_.where(F.col("members") > near.block)
    few = short.where("label <> largest").select("value", F.col("me").alias("x"), F.col("label").alias("lx"))
    all_ = short.select("value", F.col("me").alias("y"), F.col("label").alias("ly"))
    second = few.join(all_, "value").where((F.col("lx") != F.col("ly")) & possible("x", "y"))
    second = second.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    more = _confirmed(second.distinct(), sets, near).unionByName(_tiled(long_, sets, near))
    label = components(links.unionByName(more), "a", "b")

    named = classes.select(*key, "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*key, F.coalesce("label", "rep").alias("component"))
    full = texts.where("n > 0").select("id", *key).join(named, key).select("id", "n", "component")
    alone = texts.where("n = 0").select("id", "n", F.col("id").alias("component"))
    unnamed = raw.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    return full.unionByName(alone).unionByName(unnamed).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """The documents that are named after themselves; rows without id stay, of repeated ids one row stays."""
    kept = near_duplicates(docs, id, text, near).where("kept and doc_id is not null").select(F.col("doc_id").alias(id))
    rows = docs.join(kept, id, "left_semi").select(docs.columns)
    return rows.dropDuplicates([id]).unionByName(docs.where(F.col(id).isNull()))
