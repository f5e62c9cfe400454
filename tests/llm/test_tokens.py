"""Operators 12 and 13 against the tokenizer libraries."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment as alignment_module
from plumbline.llm import chunk_bpe as chunk_module
from plumbline.llm.alignment import alignment, common_cuts, sentence_piece
from plumbline.llm.bpe import DIGESTS, read_ranks
from plumbline.llm.chunk_bpe import Encoder, JsonVocabulary, chunk_bpe, chunk_cuts, decoded_texts, digests_of
from plumbline.llm.queries import QUERIES
from plumbline.llm.words import utf8

FOLDER = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", " ", "  ", "\n", "'re", "'", "'l", "ll", "1", "22", "é", "日本", "😀", "é", "the", " the", "ing", " ", "▁", "!", "...", "<|endoftext|>", "<|end", "oftext|>"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("z") for c in ("lang", "block", "pair", "n", "bucket", "part", "ids", "rows", "keys")})


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    shared = "".join(rng.choice(SIGNS) for _ in range(400))
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(120))) for _ in range(n)]
    texts += [shared[k:] + texts[k] for k in range(20)] + ["", " ", "   ", "<|endoftext|>", "\n\n ", "a ", "x" * 5000, " " * 3000 + "a", "ab" * 2000]
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate({97: 98, 98: 97})
    return texts + [thue, thue.translate({97: 98, 98: 97}), thue + " " + thue.translate({97: 98, 98: 97})]


@pytest.fixture(scope="module")
def coder():
    return Encoder(JsonVocabulary(read_ranks(JSON)))


@pytest.mark.parametrize("spacing", [2, 7, 128])
def test_chunks_encode_as_the_library_does(coder, monkeypatch, spacing):
    monkeypatch.setattr(chunk_module, "SPACING", spacing)
    monkeypatch.setattr(chunk_module, "WINDOW", 4)
    coder.chunks.clear()
    library = Tokenizer.from_file(JSON)
    for seed in range(4):
        texts = odd_texts(seed)
        ids, first = coder.encode(*utf8(pa.array(texts)))
        for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[first[k] : first[k + 1]].tolist() == want.ids, texts[k]
        assert decoded_texts(coder.vocab, ids, first) == [library.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(first, first[1:])]


def test_every_code_point_as_the_library_does(coder):
    library = Tokenizer.from_file(JSON)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    ids, first = coder.encode(*utf8(pa.array(texts)))
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == want.ids


def test_broken_bytes_decode_as_the_library_does(coder):
    library = Tokenizer.from_file(JSON)
    rng = random.Random(1)
    runs = [[rng.randrange(50257) for _ in range(rng.randrange(9))] + [rng.randrange(256) for _ in range(4)] for _ in range(500)]
    first = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    got = decoded_texts(coder.vocab, np.array([i for r in runs for i in r]), first)
    assert got == [library.decode(r, skip_special_tokens=False) for r in runs]


def test_cuts_follow_the_content():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    cuts = chunk_cuts(*utf8(pa.array([shared, "xyz" + shared, ""])))
    assert len(cuts[0]) > 5 and {c + 3 for c in cuts[0]} <= set(cuts[1]) and cuts[2] == []


def test_chunk_bpe_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "<|endoftext|>x"), (2, None), (3, "")]
    got = chunk_bpe(documents(spark, rows), JSON).collect()
    library = Tokenizer.from_file(JSON)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, list(r.ids), r.decoded)) for r in got)
    assert chunk_bpe(documents(spark, rows).where("doc_id > 9"), JSON, finish=digests_of, schema=DIGESTS).collect() == []


def test_chunk_bpe_over_a_whole_table(spark):
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_chunk_bpe"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert got[r.doc_id] == (len(ids), sha256(packed).hexdigest(), sha256((r.text or "").encode()).hexdigest())


def token_bytes():
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = chunk_module.alphabet()

    def left(text):
        ids = plain.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in plain.id_to_token(i)) for i in ids]

    def right(text):
        ids = model.encode(text)
        names = [model.id_to_piece(i) for i in ids]
        return ids, [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names)]

    return left, right


def plain_alignment(texts):
    """Rows by definition, in order of the texts."""
    left, right = token_bytes()
    made, counts = [], Counter()
    for text in texts:
        (a, bytes_a), (b, bytes_b) = (left(text), right(text)) if text else (([], []), ([], []))
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        for k, end in enumerate(ends_a):
            for m, other in enumerate(ends_b):
                if max(end - len(bytes_a[k]), other - len(bytes_b[m])) < min(end, other):
                    links.append((a[k], b[m]))
        counts.update(set(links))
        made.append((a, b, groups, links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for a, b, groups, links in made:
        body = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = sha256(body.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


def rows_of(df):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_loops(spark, monkeypatch, small):
    if small:
        for name, value in (("SLICE", 300), ("BUCKET", 20), ("ASKED", 30), ("PAIRS", 50)):
            monkeypatch.setattr(alignment_module, name, value)
    texts = [t[:400] for t in odd_texts(7, 25)] + [None, "", "same text", "same text", "a▁b", "tail  ", "日本語 " * 30]
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)]
    got = rows_of(alignment(documents(spark, rows), JSON, MODEL))
    want = list(zip((i for i, _ in rows), plain_alignment(texts)))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_alignment_of_an_empty_table_and_without_tokens(spark):
    docs = documents(spark, [(1, None), (2, "")])
    assert rows_of(alignment(docs.where("doc_id > 9"), JSON, MODEL)) == []
    assert sorted(rows_of(alignment(docs, JSON, MODEL))) == [(1, (0, 0, 0, 0, 0, 0, "")), (2, (0, 0, 0, 0, 0, 0, ""))]


def test_alignment_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    small = [r for r in docs.collect() if len(r.text or "") < 3000]
    got = dict(rows_of(alignment(docs.where("text is null or length(text) < 3000"), JSON, MODEL)))
    assert got == dict(zip((r.doc_id for r in small), plain_alignment([r.text for r in small])))
    whole = QUERIES["op12_token_alignment"](spark, FOLDER).collect()
    assert len(whole) == docs.count() and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in whole)


def test_cuts_are_the_shared_ends():
    rng = np.random.default_rng(4)
    for size, density in ((1, 1), (2000, 0.5), (3000, 0.02), (5000, 0.9)):
        ends = np.arange(1, size + 1)
        keep_a, keep_b = rng.random(size) < density, rng.random(size) < density
        last = np.unique(np.append(rng.integers(0, size, 5), size - 1))
        keep_a[last] = keep_b[last] = True
        a, b = ends[keep_a], ends[keep_b]
        first = np.concatenate(([0], np.searchsorted(a, ends[last]) + 1))
        assert a[common_cuts(a, b, first)].tolist() == np.intersect1d(a, b).tolist()


def test_words_alone_encode_as_the_whole_text_does():
    side, model = sentence_piece(read_ranks(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in odd_texts(9):
        if text and "▁" not in text:
            assert side.pieces.tokens([side.split(" " + text)])[0].tolist() == model.encode(text), text
    assert re.findall(" +[^ ]*", "  a b ") == ["  a", " b", " "]


def test_pieces_of_equal_hash_are_told_apart():
    from plumbline.llm.bpe import Vocabulary, encode
    import tiktoken, base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocab = Vocabulary(read_ranks(path))
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in read_ranks(path).splitlines() if line)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for size in (1024, 2048):
        thue = "a"
        while len(thue) < size:
            thue += thue.translate({97: 98, 98: 97})
        other = thue.translate({97: 98, 98: 97})
        texts = [thue, other, f"{thue} {other} {thue}", f"x {other} {other}", ""]
        ids, first, _ = encode(vocab, *utf8(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(t) for t in texts]
