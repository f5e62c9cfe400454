"""Operator 9: benchmark questions in documents, also with other numbers, names and units."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import ship
from plumbline.llm.storage import stored
from plumbline.llm.words import BYTE_BASE, LOWER, mix, rolling, slices, split, utf8, windows

#: Words that are units behind a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l dl gal s sec min h hr hrs ms hz khz mhz ghz w kw kwh v a j kj cal kcal "
    "n pa kpa bar k c f usd eur gbp dollars euros pounds cents percent degrees meters metres kilometers kilometres miles "
    "feet inches grams kilograms liters litres seconds minutes hours days weeks months years"
).split()
NUMBER, NAME, UNIT = (np.uint64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
WRITTEN = np.uint64(0x589965CC75374CC3)
#: Kinds of windows: canonical tokens, tokens as written, the item's tokens in lower case.
TEMPLATE, AS_WRITTEN, LOWERED = range(3)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?:;"]] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
NUMERIC = DIGITS.copy()
NUMERIC[[ord(c) for c in ".,-+/"]] = True


@dataclass(frozen=True)
class Rule:
    """Windows of ``width`` tokens: canonical, if half of them are literal at least, as written, and in lower case.

    An item is found in a text if, at one place, ``share`` of its tokens or ``tokens`` of
    them lie in equal windows; more than ``share``, if some are equal in lower case only.
    A window with other slot values than the item's counts only if it holds no slot value
    of the item that stands for two values at that place.  ``broadcast`` bounds the
    windows that one pass over the documents carries to each task.
    """

    width: int = 8
    share: float = 0.5
    tokens: int = 13
    broadcast: int = 2_000_000


@dataclass
class Tokens:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    slot: np.ndarray

    def written(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")

    def value(self, k: int) -> str:
        return self.written(k).lower()


def canonical(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words without outer punctuation: a number, name or unit is a typed placeholder, all else its lower case.

    A name is a capitalised word that does not begin a sentence; a unit follows a number.
    """
    words = split(data, offsets)
    starts, ends = words.starts.copy(), words.ends.copy()
    open_ = np.arange(len(starts))
    while len(open_ := open_[PUNCTUATION[data[starts[open_]]]]):
        starts[open_] += 1
        open_ = open_[starts[open_] < ends[open_]]
    open_ = np.flatnonzero(starts < ends)
    while len(open_ := open_[PUNCTUATION[data[ends[open_] - 1]]]):
        ends[open_] -= 1
    left = np.flatnonzero(starts < ends)
    stop = np.zeros(len(words.starts), bool)
    trailing = np.minimum(ends, len(data) - 1)
    stop[left] = (ends[left] < words.ends[left]) & (STOPS[data[trailing[left]]] | STOPS[data[words.ends[left] - 1]])
    empty = np.flatnonzero(starts >= ends)
    stop[empty] = STOPS[data[words.ends[empty] - 1]]
    begins = np.ones(len(words.starts), bool)
    begins[1:] = stop[:-1] | (words.text[1:] != words.text[:-1])
    starts, ends, text, begins = starts[left], ends[left], words.text[left], begins[left]

    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    low = np.where(accented, data + np.uint8(0x20), LOWER[data])
    hashes = rolling(low.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)
    if len(starts):
        digits = np.concatenate(([0], np.cumsum(DIGITS[data])))
        numeric = np.concatenate(([0], np.cumsum(NUMERIC[data])))
        number = (digits[ends] > digits[starts]) & (numeric[ends] - numeric[starts] == ends - starts)
        second = np.minimum(starts + 1, len(data) - 1)
        capital = ((data[starts] >= 65) & (data[starts] <= 90)) | accented[second] & (data[starts] == 0xC3)
        after = np.append(False, number[:-1]) & np.append(False, text[1:] == text[:-1])
        unit = after & np.isin(hashes, _unit_hashes())
        name = capital & ~begins & ~number & ~unit
        hashes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
        slot = number | unit | name
    else:
        slot = np.zeros(0, bool)
    return Tokens(data, starts, ends, text, np.searchsorted(text, np.arange(len(offsets))), hashes, slot)


def _unit_hashes() -> np.ndarray:
    data, offsets = utf8(pa.array(list(UNITS)))
    return np.sort(split(data, offsets).hashes())


def template_windows(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window that is half literal."""
    at, found = windows(tokens.hashes, tokens.text, width)
    slots = np.concatenate(([0], np.cumsum(tokens.slot)))
    literal = 2 * (slots[at + width] - slots[at]) <= width
    return at[literal], mix(found[literal] + np.uint64(width))


def written_windows(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every window, of the tokens as they are written."""
    hashes = rolling(tokens.data.astype(np.uint64) + np.uint64(1), tokens.starts, tokens.ends, BYTE_BASE)
    at, found = windows(hashes, tokens.text, width)
    return at, mix(found + np.uint64(width) ^ WRITTEN)


WINDOWS = "id long, n int, pos int, width int, kind int, window long, slots array<string>, words string"


def _slots(tokens: Tokens, at: int, width: int) -> list[str]:
    return [tokens.value(k) for k in range(at, at + width) if tokens.slot[k]]


def _words(tokens: Tokens, at: int, width: int) -> str:
    return " ".join(tokens.written(k) for k in range(at, at + width))


def benchmark_windows(items: DataFrame, id: str, text: str, rule: Rule) -> DataFrame:
    """Windows of the items, of every kind; an item of fewer tokens is one window."""
    ship(items.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("width", pa.int32()),
                        ("kind", pa.int32()), ("window", pa.int64()), ("slots", pa.list_(pa.string())), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            tokens = canonical(data, offsets)
            lowered = canonical(*utf8(pa.array([(t or "").lower() for t in batch.column(1).to_pylist()], pa.string())))
            n, rows = np.diff(tokens.first), []
            for width in range(1, rule.width + 1):
                written = written_windows(tokens, width)
                at, low = written_windows(lowered, width)
                changed = low != written[1]
                for kind, (at, found), words in ((TEMPLATE, template_windows(tokens, width), None), (AS_WRITTEN, written, tokens),
                                                 (LOWERED, (at[changed], low[changed]), lowered)):
                    t = tokens.text[at]
                    for k in np.flatnonzero((n[t] == width) | ((width == rule.width) & (n[t] > width))):
                        a = int(at[k])
                        rows.append({"id": batch.column(0)[t[k]].as_py(), "n": int(n[t[k]]), "pos": a - int(tokens.first[t[k]]),
                                     "width": width, "kind": kind, "window": int(found[k].view(np.int64)),
                                     "slots": _slots(tokens, a, width), "words": words and _words(words, a, width)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = items.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, WINDOWS)


HITS = "array<struct<pos:int,window:long,slots:array<string>,words:string>>"


def _hits(docs: DataFrame, known: np.ndarray, widths: list[int], every_key: bool) -> DataFrame:
    """doc_id, key (hash of the text, if it has a hit or ``every_key`` is set) and hits of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(known))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("hits", pa.list_(pa.struct([
        ("pos", pa.int32()), ("window", pa.int64()), ("slots", pa.list_(pa.string())), ("words", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.view(np.uint64)
        known = np.sort(known)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                cut = offsets[a : b + 1]
                tokens = canonical(data[cut[0] : cut[-1]], cut - cut[0])
                hits: dict[int, list] = {}
                for width in widths:
                    if not len(known):
                        break
                    for (at, found), written in ((template_windows(tokens, width), False), (written_windows(tokens, width), True)):
                        near = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        for k in np.flatnonzero(known[near] == found):
                            start = int(at[k])
                            text = int(tokens.text[start])
                            hits.setdefault(text, []).append({
                                "pos": start - int(tokens.first[text]), "window": int(found[k].view(np.int64)),
                                "slots": [] if written else _slots(tokens, start, width),
                                "words": _words(tokens, start, width) if written else None})
                keys = [blake2b(tokens.data[cut[t] - cut[0] : cut[t + 1] - cut[0]].tobytes(), digest_size=16).hexdigest()
                        if every_key or t in hits else None for t in range(b - a)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(keys, pa.string()),
                    pa.array([hits.get(t, []) for t in range(b - a)], schema.field("hits").type)], schema=schema)

    return docs.mapInArrow(run, f"doc_id long, key string, hits {HITS}")


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Find benchmark items in documents by template windows, and by windows as written or in lower case.

    Hashes of the items' windows go to every task, as many at a time as ``rule.broadcast``
    allows; a larger benchmark takes several passes.  Hits are joined to the items'
    windows by hash and grouped by text, item and place (the distance of the positions),
    so each copy is judged alone, by the item's tokens that its windows cover.  Where equal
    slot values of the item have become unequal ones, the windows that hold them do not
    count, but for windows whose slot values are the item's own.  Windows as written or in
    lower case also compare the words, so items rich in numbers or names are found too.

    Result: doc_id, contaminated, items (ids found, sorted) and coverage (largest share of
    a found item's tokens, else 0).  One row per input row.  Null and empty texts and items
    without id match nothing; an item without a window that is half literal is found as
    written or in lower case only; repeated rows get equal results; an empty table gives
    no rows, and without items every row is clean.  Other columns are ignored.
    """
    bench = stored(benchmark_windows(items, item, item_text, rule))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())
    windows_ = bench.select("window").distinct()
    passes = max(1, -(-windows_.count() // rule.broadcast))
    none = F.array().cast("array<long>")
    if not widths:
        return rows.select("doc_id", F.lit(False).alias("contaminated"), none.alias("items"), F.lit(0.0).alias("coverage"))
    parts = []
    for k in range(passes):
        mine = windows_.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k) if passes > 1 else windows_
        parts.append(stored(_hits(rows, mine.toArrow()["window"].to_numpy(), widths, passes > 1)))
    hit = parts[0]
    for part in parts[1:]:
        hit = hit.unionByName(part)
    items_ = bench.select(F.col("id").alias("item"), "n", F.col("pos").alias("item_pos"), "width", "kind", "window",
                          F.col("slots").alias("item_slots"), F.col("words").alias("item_words"))
    one = hit.where(F.size("hits") > 0).select("key", F.explode("hits").alias("h")).select("key", "h.*").distinct()
    same = one.join(items_, "window").where(F.col("words").eqNullSafe(F.col("item_words")))
    slots = F.when(F.col("kind") == TEMPLATE, F.col("slots")).otherwise(F.col("item_slots"))
    matched = stored(same.withColumn("slots", slots).withColumn("place", F.col("pos") - F.col("item_pos")).drop("words", "item_words"))
    spot = ["key", "item", "place"]
    pairs = matched.select(*spot, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*spot, "s.item_slots", "s.slots")
    broken = pairs.distinct().groupBy(*spot, "item_slots").count().where("count > 1")
    broken = broken.groupBy(*spot).agg(F.collect_list("item_slots").alias("broken"))
    sound = (F.col("slots") == F.col("item_slots")) | F.col("broken").isNull() | ~F.arrays_overlap("item_slots", "broken")
    left = matched.join(broken, spot, "left").where(sound)
    covered = left.select(*spot, "n", (F.col("kind") < LOWERED).cast("int").alias("cased"),
                          F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("width") - 1)).alias("token"))
    covered = covered.groupBy(*spot, "token").agg(F.max("cased").alias("cased"), F.max("n").alias("n"))
    covered = covered.groupBy(*spot).agg(F.count("*").alias("covered"), F.sum("cased").alias("cased"), F.max("n").alias("n"))
    least = F.col("n") * rule.share
    found = covered.where((F.col("cased") >= least) | (F.col("covered") > least) | (F.col("covered") >= rule.tokens))
    verdict = found.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("covered") / F.col("n")).alias("coverage"))
    marked = parts[0].select("doc_id", "key")
    clean = marked.where("key is null").select("doc_id", F.lit(False).alias("contaminated"), none.alias("items"), F.lit(0.0).alias("coverage"))
    suspect = marked.where("key is not null").join(verdict, "key", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    return clean.unionByName(suspect)
