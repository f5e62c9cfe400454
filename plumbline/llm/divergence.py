"""Operator 11: which sources of a language use other terms than the rest, and which terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.chunks import ship
from plumbline.llm.storage import stored
from plumbline.llm.words import LOWER, slices, utf8

SLICE = 1_000_000
#: Rows that a task adds up before it sends them on, and entries (term, source) of a tile.
ROWS = 500_000
TILE = 100_000
#: Probabilities are integers out of this.
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
TILES = "lang string, source string, item string, high long, low long"

#: Bytes of a term: ASCII letters, and every byte of a character beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
#: Longest terms of one and of two words of eight bytes.
ONE, TWO = 8, 16


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each term; texts lie one behind the other."""
    inside = IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends - starts, text


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes from each start as one big-endian word, zero behind the end; ``data`` is padded."""
    rows = np.lib.stride_tricks.sliding_window_view(data, 8)[starts]
    word = np.ascontiguousarray(rows).view(">u8").reshape(-1).astype(np.uint64)
    unused = (64 - 8 * np.clip(lengths, 1, 8)).astype(np.uint64)
    return np.where(lengths > 0, (word >> unused) << unused, np.uint64(0))


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order of rows by their words, the first most significant: counting sorts of 16-bit digits from the right."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(fresh: np.ndarray, group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, occurrences and texts of each run of equal (term, group); rows of a run lie in order of text."""
    at = np.flatnonzero(fresh | np.append(True, group[1:] != group[:-1]))
    another = fresh | np.append(True, text[1:] != text[:-1])
    return at, np.diff(np.append(at, len(fresh))), np.add.reduceat(another.astype(np.int64), at)


def strings(matrix: np.ndarray) -> pa.Array:
    """Rows of bytes, zero behind the end, as strings."""
    used = matrix != 0
    offsets = np.concatenate(([0], np.cumsum(used.sum(1)))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(matrix), pa.py_buffer(offsets), pa.py_buffer(matrix[used])).cast(pa.string())


def short_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, text: np.ndarray, words: int):
    """Terms of up to ``words`` times eight bytes: packed, radix-sorted, counted in runs."""
    parts = [packed(data, starts + 8 * k, lengths - 8 * k) for k in range(words)]
    order = radix_order(*parts)
    parts = [p[order] for p in parts]
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for p in parts:
        fresh[1:] |= p[1:] != p[:-1]
    group, text = group[order], text[order]
    at, n, docs = run_counts(fresh, group, text)
    matrix = np.stack([p[at] for p in parts], 1).astype(">u8").view(np.uint8).reshape(len(at), 8 * words)
    return strings(matrix), group[at], n, docs


def long_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, text: np.ndarray, width: int):
    """Terms of ``width / 2`` to ``width`` bytes, sorted as byte strings."""
    room = np.zeros((len(starts), width), np.uint8)
    for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        room[k, :n] = data[a : a + n]
    term = room.reshape(-1).view(f"S{width}")
    order = np.argsort(term, kind="stable")
    term, group, text = term[order], group[order], text[order]
    at, n, docs = run_counts(np.append(True, term[1:] != term[:-1]), group, text)
    return strings(room[order[at]]), group[at], n, docs


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of whole texts with group, occurrences and number of texts, by buckets of length; texts are ordered by group."""
    starts, lengths, text = term_bounds(data, offsets)
    room = np.concatenate((LOWER[data], np.zeros(TWO, np.uint8)))
    longest = int(lengths.max(initial=0))
    floor, width = 0, ONE
    while floor < longest:
        at = np.flatnonzero((lengths > floor) & (lengths <= width))
        if len(at):
            rows = room, starts[at], lengths[at], group[text[at]], text[at]
            yield short_terms(*rows, width // 8) if width <= TWO else long_terms(*rows, width)
        floor, width = width, 2 * width


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Partial counts; the term '' marks that a group occurs."""
    ship(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            held.append(part)
            size += part.num_rows
            if size > ROWS:
                yield from added(held)
                held, size = [], 0
        if held:
            yield from added(held)

    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["lang", "source", "term"], use_threads=False)
        table = table.aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(schema.names).to_batches(max_chunksize=50_000)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.table([batch.column(0), batch.column(1)], names=["lang", "source"]).combine_chunks()
            place: dict[tuple[str, str], int] = {}
            group = np.array([place.setdefault(p, len(place)) for p in zip(names["lang"].to_pylist(), names["source"].to_pylist())], np.int64)
            langs, sources = (pa.array([pair[k] for pair in place], pa.string()) for k in (0, 1))
            order = np.argsort(group, kind="stable")
            data, offsets = utf8(batch.column(2).take(pa.array(order)))
            group = group[order]

            def rows(term: pa.Array, g: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
                at = pa.array(g)
                columns = [langs.take(at), sources.take(at), term, pa.array(n, pa.int64()), pa.array(d, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, schema=schema)

            every = np.arange(len(place))
            yield rows(pa.array([""] * len(place), pa.string()), every, 0 * every, 0 * every)
            for a, b in slices(offsets, SLICE):
                cut = offsets[a : b + 1]
                for found in counted(data[cut[0] : cut[-1]], cut - cut[0], group[a:b]):
                    yield rows(*found)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*columns).mapInArrow(run, COUNTS)


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), in decimals."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 1)
    return (F.call_function("div", whole, (total + kept).cast("decimal(19,0)")) + 1).cast("long")


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _probability(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    if (int(n.max(initial=0)) + 1) * SCALE < 1 << 63:
        return 1 + SCALE * (n + 1) // (total + kept)
    return np.array([1 + SCALE * (int(x) + 1) // (total + kept) for x in n], np.int64)


def _tile(key: tuple[pa.Scalar, ...], counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sum of ``spread`` over the terms of a tile for each ordered pair of sources.

    Against one source's dense probabilities, only the terms that the other has are
    looked at; those it lacks have one q, and a source's distinct p are few.  Sums go out
    in two halves of 32 bits.
    """
    order = np.argsort(groups["source"].to_numpy(zero_copy_only=False).astype(object), kind="stable")
    groups = groups.take(pa.array(order))
    names = groups["source"].to_pylist()
    total, kept = groups["total"].to_numpy(), groups["kept"].to_numpy()
    number = {s: k for k, s in enumerate(names)}
    who = np.array([number[s] for s in counts["source"].to_pylist()], np.int64)
    terms = counts["term"].combine_chunks()
    terms = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).dictionary_encode()
    column, n = terms.indices.to_numpy(), counts["n"].to_numpy()
    order = np.lexsort((column, who))
    who, column, n = who[order], column[order], n[order]
    cut = np.searchsorted(who, np.arange(len(names) + 1))
    width = len(terms.dictionary)
    lacking = np.array([_probability(np.zeros(1, np.int64), int(t), int(k))[0] for t, k in zip(total, kept)], np.int64)
    have = np.concatenate([_probability(n[a:b], int(t), int(k)) for a, b, t, k in zip(cut, cut[1:], total, kept)])
    held = np.flatnonzero(np.diff(cut))
    out = []
    for g in range(len(names)):
        p = np.full(width, lacking[g], np.int64)
        p[column[cut[g] : cut[g + 1]]] = have[cut[g] : cut[g + 1]]
        values, times = np.unique(p, return_counts=True)
        high, low = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for q in np.unique(lacking):
            f = (values - q) ** 2 // q
            high[lacking == q] = ((f >> 32) * times).sum()
            low[lacking == q] = ((f & 0xFFFFFFFF) * times).sum()
        mine = p[column]
        f, without = (mine - have) ** 2 // have, (mine - lacking[who]) ** 2 // lacking[who]
        high[held] += np.add.reduceat((f >> 32) - (without >> 32), cut[held])
        low[held] += np.add.reduceat((f & 0xFFFFFFFF) - (without & 0xFFFFFFFF), cut[held])
        other = np.arange(len(names)) != g
        out.append(pa.table({
            "lang": pa.array([key[0].as_py()] * int(other.sum()), pa.string()), "source": pa.array([names[g]] * int(other.sum()), pa.string()),
            "item": pa.array([s for s, o in zip(names, other) if o], pa.string()), "high": high[other], "low": low[other],
        }))
    return pa.concat_tables(out)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """How far the sources of each language are from each other, and by which terms from the language.

    Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are
    lower-cased.  A language keeps the terms of at least ``least_docs`` of its rows.  In
    tasks, terms of up to 8 and 16 bytes become one and two integers that are
    radix-sorted and counted in runs; longer ones are sorted as bytes in buckets of
    doubling width.  Spark adds the counts up by (lang, source, term).  Sums over all
    terms for pairs of sources come from tiles of terms of bounded size; the pairs
    themselves are the result and grow with the square of a language's sources.

    Result: lang, source, part (``pair``: every other source of the language, ``term``:
    the ``top`` terms a source uses more than its language), item, value, rank (ties to
    the smaller item by bytes).  Arithmetic is exact; a value above 2**63 is an error.
    Null text, lang and source count as ''.  A group without terms still has pairs.
    A row is a document, also where ids repeat.  Other columns are ignored; an empty
    table gives no rows.
    """
    partial = term_counts(docs, text, lang, source).repartition("lang", "term")
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    whole = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    whole = whole.where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(counts.where("term <> ''").drop("docs").join(whole, ["lang", "term"]))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("rows"))
    groups = counts.where("term = ''").select("lang", "source").join(totals.drop("rows"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0))

    by_lang = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    by_group = probability(F.col("n"), F.col("total"), F.col("kept"))
    scored = kept.join(groups, ["lang", "source"]).withColumns({"p": by_group, "q": by_lang}).where("p > q")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    tiles = F.greatest(F.ceil(F.col("rows") / TILE), F.lit(1))
    dealt = kept.join(langs.select("lang", tiles.alias("tiles")), "lang")
    dealt = dealt.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "tiles").alias("tile"))
    beside = groups.where("kept > 0").select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    sums = dealt.groupBy("lang", "tile").cogroup(beside.groupBy("lang", "tile")).applyInArrow(_pairs_of_tile, TILES)
    high, low = F.sum(F.col("high").cast("decimal(28,0)")), F.sum(F.col("low").cast("decimal(28,0)"))
    sums = sums.groupBy("lang", "source", "item").agg((high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("long").alias("value"))
    empty = groups.where("kept = 0").select("lang", "source")
    none = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = sums.unionByName(none).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(terms)


def _pairs_of_tile(key: tuple[pa.Scalar, ...], counts: pa.Table, groups: pa.Table) -> pa.Table:
    if not counts.num_rows or not groups.num_rows:
        names = ("lang", "source", "item", "high", "low")
        return pa.table({n: pa.array([], pa.string() if k < 3 else pa.int64()) for k, n in enumerate(names)})
    return _tile(key, counts, groups)
