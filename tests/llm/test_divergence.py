"""Operator 11 against a plain version, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence as module
from plumbline.llm.divergence import counted, divergence, radix_order
from plumbline.llm.words import utf8

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    terms = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for _, text, lang, source in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        groups[lang].add(source)
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in seen[lang].items() if n >= least)

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode(), o) for o in sources if o != s]
            more = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def answer(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("tile, top", [(100_000, 200), (7, 3)])
def test_divergence_against_loops(spark, monkeypatch, tile, top):
    monkeypatch.setattr(module, "TILE", tile)
    rng = random.Random(5)
    words = ["a", "A", "Éa", "éa", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "x" * 40, "x" * 40 + "y", "日本", "it's", "b2b", "Z"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de"]), f"s{rng.randrange(4)}") for k in range(60)]
    rows += [(None, None, "en", "silent"), (7, "", None, None), (7, "once only", None, "b"), (8, "1 2 3", "fr", "p"), (9, None, "fr", "q"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("term", "n", "docs", "tile", "value", "rank", "kept", "total")})
    assert answer(divergence(docs, top=top)) == plain(rows, top=top)


def test_divergence_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert divergence(docs).collect() == []


def test_terms_never_cross_texts_and_count_texts():
    data, offsets = utf8(pa.array(["ab", "Ab cd", "", "cd" * 6 + " ab", "é" * 30]))
    found = [(t, int(g), int(n), int(d)) for terms, gs, ns, ds in counted(data, offsets, np.array([0, 0, 0, 1, 1]))
             for t, g, n, d in zip(terms.to_pylist(), gs, ns, ds)]
    assert sorted(found) == sorted([("ab", 0, 2, 2), ("ab", 1, 1, 1), ("cd", 0, 1, 1), ("cd" * 6, 1, 1, 1), ("é" * 30, 1, 1, 1)])


def test_radix_order_is_that_of_the_words():
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, 4, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    assert (radix_order(high, low) == np.lexsort((low, high))).all()
