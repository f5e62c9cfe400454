"""Documents dealt into chunks, and compact columns of integers.

A chunk is a hash class of documents whose texts together have a bounded size, so one
task can hold it.  Texts travel compressed.  Operators that must ask the whole corpus
about every window of every text send, per chunk, sorted and compressed hashes to
buckets of the hash space, and the buckets answer to the chunks; a frequent hash
counts once per chunk, so no key gathers more than one entry from each.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline

SMALLEST_CHUNK, LARGEST_CHUNK = 2_000_000, 64_000_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(plumbline.__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="plumbline-source-")
        sc.addPyFile(shutil.make_archive(f"{folder}/plumbline_source", "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)


@dataclass(frozen=True)
class Sizes:
    """Chunks of texts and buckets of hashes for a corpus of ``chars`` characters.

    Both grow with the square root of the corpus until a task's memory bounds them,
    so a chunk sends each bucket a worthwhile number of hashes at any size.
    """

    chars: int

    @property
    def chunk_chars(self) -> int:
        return min(LARGEST_CHUNK, max(SMALLEST_CHUNK, int(70 * math.sqrt(self.chars))))

    @property
    def chunks(self) -> int:
        return max(1, math.ceil(self.chars / self.chunk_chars))

    @property
    def buckets(self) -> int:
        return max(4, math.ceil(self.chars / (4 * self.chunk_chars)))


def sizes(docs: DataFrame, text: str) -> Sizes:
    chars = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0]
    return Sizes(int(chars or 0))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of a group, or of two together, that gives its memory back at the end of each."""

    def grouped(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = work(key, table)
        give_back()
        return out

    def cogrouped(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(key, left, right)
        give_back()
        return out

    return grouped if work.__code__.co_argcount == 2 else cogrouped


def pack_table(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack_tables(packs: pa.ChunkedArray) -> pa.Table | None:
    """All packed rows of a chunk, ordered by id, then text."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for chunk in packs.chunks for p in chunk]
    if not parts:
        return None
    table = pa.concat_tables(parts).combine_chunks()
    return table.take(pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names]))


def dealt(docs: DataFrame, id: str, text: str, chunks: int) -> DataFrame:
    """``chunk`` and ``pack``: rows (id, text) by hash of the id, or of the text where the id is null."""
    ship(docs.sparkSession)
    number = F.col(id).cast("long")  # an int hashes otherwise than a long
    key = F.xxhash64(F.when(number.isNull(), F.col(text)), number)
    rows = docs.select(F.pmod(key, F.lit(chunks)).alias("chunk"), number.alias("id"), F.col(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table.take(pc.sort_indices(table, sort_keys=[("chunk", "ascending")])).combine_chunks()
            chunk = table["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
            body = table.drop_columns(["chunk"])
            packs = [pack_table(body.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk[cuts[:-1]]), pa.array(packs, pa.binary())], names=["chunk", "pack"]
            )
        give_back()

    return rows.mapInArrow(pack, "chunk long, pack binary")


def squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, as byte planes under zstd: high bytes that hardly vary cost nothing."""
    codec = pa.Codec("zstd", 1)
    out = [len(columns[0]).to_bytes(8, "little")] if columns else []
    for column in columns:
        planes = np.ascontiguousarray(column.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
        for plane in planes:
            body = codec.compress(plane.tobytes(), asbytes=True) if plane.any() else b""
            if len(body) >= len(plane):
                body = b"\1" + plane.tobytes()
            elif body:
                body = b"\2" + body
            out += [len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def expand(blob: bytes, columns: int) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(columns):
        planes = np.zeros((8, n), np.uint8)
        for k in range(8):
            size = int.from_bytes(blob[at : at + 4], "little")
            body = blob[at + 4 : at + 4 + size]
            at += 4 + size
            if size and body[:1] == b"\1":
                planes[k] = np.frombuffer(body, np.uint8, n, 1)
            elif size:
                planes[k] = np.frombuffer(codec.decompress(body[1:], n, asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.astype(np.uint64)
    out[1:] -= out[:-1].copy()
    return out


def undo(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers that occur in sorted 64-bit hashes, and where each begins and the last ends."""
    bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1)) if len(bucket) else np.zeros(0, np.int64)
    return bucket[cuts].astype(np.int64), np.concatenate((cuts, [len(bucket)])).astype(np.int64)
