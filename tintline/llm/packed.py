"""Documents packed into chunks, and counts over all chunks that come back to each.

Several operators need, for every n-gram, lane or anchor of a document, in how
many places of the whole corpus it occurs. One row for each occurrence would be
many times the input. Here a chunk of documents sends each hash range one sorted
block of its distinct hashes with their counts, so a frequent hash is one entry
for each chunk; the ranges add up, and each block's sums come back to its chunk.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

U64 = np.uint64
#: Text of a chunk, in bytes; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Rows of a chunk at most: a row's number within its chunk has 20 bits.
CHUNK_ROWS = 1 << 20
#: Entries that one hash range is to hold.
RANGE_ENTRIES = 3_000_000
#: Bytes whose words are hashed at once: eight bytes of memory go to each, several times over.
SLICE_BYTES = 1 << 18


@dataclass
class Chunk:
    """Documents of a chunk: ids with their validity, and the texts' bytes end to end."""

    number: int
    ids: np.ndarray
    has_id: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]

    @property
    def uids(self) -> np.ndarray:
        """A number for each row of the corpus."""
        return (self.number << 20) + np.arange(len(self), dtype=np.int64)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.has_id)


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column; nulls count as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + squeeze(planes.tobytes())


def unpack_ints(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(unsqueeze(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


CHUNK_SCHEMA = "chunk long, n_bytes long, ids binary, has_id binary, lengths binary, body binary, rest binary"


def _pack(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Column 0 is the id, column 1 the text; others travel along as ``rest``."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        at, data = binary_buffers(batch.column(1))
        ids = batch.column(0)
        has, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
        begin = 0
        while begin < len(ids):
            end = int(np.searchsorted(at, at[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), len(ids), begin + CHUNK_ROWS)
            rest = batch.slice(begin, end - begin).select(range(2, batch.num_columns)) if batch.num_columns > 2 else None
            row = {
                "chunk": first + (part << 20) + number,
                "n_bytes": int(at[end] - at[begin]),
                "ids": values[begin:end].astype("<i8").tobytes(),
                "has_id": np.packbits(has[begin:end]).tobytes(),
                "lengths": np.diff(at[begin : end + 1]).astype("<i8").tobytes(),
                "body": squeeze(data[at[begin] : at[end]].tobytes()),
                "rest": rest and squeeze(ipc_bytes(rest)),
            }
            types = [pa.int64()] * 2 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))
            number, begin = number + 1, end


def pack_docs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, limit: int = CHUNK_BYTES, first: int = 0
) -> DataFrame:
    """Documents as chunks (one row each) of about ``limit`` bytes of text, written to the checkpoint folder.

    Later steps name a document by its chunk and place; that they are written
    keeps the names the same when a lost task is run again. With ``whole`` all
    columns travel along, for ``unpack_docs``. Chunks are numbered from ``first`` on.
    """
    columns = [F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")]
    if whole:
        others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
        columns += [F.col(text_col).isNull().alias("no_text"), *others]
    return stored(docs.select(columns).mapInArrow(partial(_pack, limit=limit, first=first), CHUNK_SCHEMA), "chunks")


def unpack_docs(chunks: DataFrame, keep: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The packed rows of ``like`` whose number is a uid of ``keep``."""
    places = keep.select(F.shiftright("uid", 20).alias("of"), F.col("uid").bitwiseAND(CHUNK_ROWS - 1).cast("int").alias("k"))
    places = places.groupBy("of").agg(F.sort_array(F.collect_list("k")).alias("places"))
    columns, types = like.columns, [f.dataType for f in like.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in chunk_rows(batches):
            at = np.array(row["places"])
            rest = pa.ipc.open_stream(unsqueeze(row["rest"])).read_next_batch()
            gone = np.asarray(rest.column(0))[at]
            texts = [None if none else chunk.text(k).tobytes().decode() for k, none in zip(at, gone, strict=True)]
            taken, out, k = rest.take(pa.array(at)), [], 1
            for c in columns:
                out.append(pa.array(texts, pa.string()) if c == text_col else taken.column(k))
                k += c != text_col
            yield pa.RecordBatch.from_arrays(out, columns)

    joined = chunks.join(places, F.col("chunk") == F.col("of")).drop("of")
    return joined.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(columns, types, strict=True)]))


def ipc_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def chunk_of(row: dict) -> Chunk:
    ids = np.frombuffer(row["ids"], "<i8")
    has = np.unpackbits(np.frombuffer(row["has_id"], np.uint8), count=len(ids)).astype(bool)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.frombuffer(row["lengths"], "<i8"), out=offsets[1:])
    return Chunk(row["chunk"], ids, has, offsets, np.frombuffer(unsqueeze(row["body"]), np.uint8))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library gives memory back in its own way
        return None


def release_memory() -> None:
    """Give freed memory back to the system: a worker's waits beside those of other tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            yield chunk_of(row), row
            del row
            release_memory()


@dataclass(frozen=True)
class Ranges:
    """Hashes of ``bits`` bits, dealt to ``parts`` ranges of equal width."""

    bits: int
    parts: int

    @property
    def width(self) -> int:
        return -(-(1 << self.bits) // self.parts)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U64(64 - self.bits)


def ranges_for(chunks: DataFrame, per_byte: float) -> Ranges:
    """Ranges for about ``per_byte`` distinct hashes for each byte of text.

    The bits are 20 more than the number of hashes needs, so of a million hashes
    about one shares its value with another, at any size of the corpus.
    """
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    entries = max(1, int(total * per_byte))
    return Ranges(min(64, max(48, 20 + math.ceil(math.log2(entries)))), max(1, math.ceil(entries / RANGE_ENTRIES)))


def _blocks(features: Callable[[Chunk], np.ndarray], ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunk_rows(batches):
            values, counts = np.unique(features(chunk), return_counts=True)
            edges = np.searchsorted(values, np.arange(ranges.parts, dtype=U64) * U64(ranges.width))
            edges = np.append(edges, len(values))
            parts = np.flatnonzero(np.diff(edges))
            hashes, sums = [], []
            for p in parts:
                block = values[edges[p] : edges[p + 1]]
                hashes.append(pack_ints(np.diff(block, prepend=U64(int(p) * ranges.width))))
                sums.append(pack_ints(counts[edges[p] : edges[p + 1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(parts), chunk.number)), pa.array(parts.astype(np.int32)), pa.array(hashes, pa.binary()), pa.array(sums, pa.binary())],
                ["chunk", "part", "hashes", "counts"],
            )

    return run


def _sums(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        release_memory()  # that of the range before
        base = U64(key[0].as_py() * width)
        blocks = [np.cumsum(unpack_ints(x.as_py())) + base for x in table.column("hashes")]
        counts = np.concatenate([unpack_ints(x.as_py()) for x in table.column("counts")])
        sizes = [len(x) for x in blocks]
        values = np.concatenate(blocks)
        del blocks
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        total = np.add.reduceat(counts[order], first)
        counts[order] = np.repeat(total, np.diff(np.append(first, len(values))))
        out = [pack_ints(x) for x in np.split(counts, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("chunk"), table.column("part"), pa.array(out, pa.binary())], names=["chunk", "part", "counts"])

    return run


def with_counts(chunks: DataFrame, features: Callable[[Chunk], np.ndarray], ranges: Ranges) -> DataFrame:
    """The chunks, each with ``sums``: packed counts of its distinct hashes over the corpus.

    ``features`` gives a chunk's hashes, cut to the ranges' bits, repeated as often
    as they count. A range's task holds about ``RANGE_ENTRIES`` entries however
    frequent single hashes are: a chunk sends each of them once.
    """
    blocks = chunks.mapInArrow(_blocks(features, ranges), "chunk long, part int, hashes binary, counts binary")
    sums = blocks.groupBy("part").applyInArrow(_sums(ranges.width), "chunk long, part int, counts binary")
    back = sums.groupBy(F.col("chunk").alias("of")).agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("sums"))
    return chunks.join(back, F.col("chunk") == F.col("of"), "left").drop("of")


def sums_of(row: dict) -> np.ndarray:
    """Counts of a chunk's distinct hashes, in the order of the hashes."""
    return np.concatenate([unpack_ints(x["counts"]) for x in row["sums"] or ()] or [np.empty(0, U64)])


# Hashing


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240229))
    plain = random.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    folded = plain.copy()
    folded[65:91] = plain[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return plain, folded, space


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    return _powers(1 << max(10, (n - 1).bit_length()), base)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits: the finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z as a-z), and the document that it is in; hashed in slices that end at white space."""
    _, folded, space = _tables()
    n = len(data)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64)
    inside = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | cut[:n]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | cut[1:])) + 1
    hashed = np.empty(len(starts), U64)
    spaces = np.flatnonzero(~inside)
    edges = np.searchsorted(spaces, np.arange(SLICE_BYTES, n, SLICE_BYTES))
    edges = spaces[edges[edges < len(spaces)]]
    for begin, end in pairwise(np.unique(np.concatenate([[0], edges, [n]])).tolist()):
        here = slice(*np.searchsorted(starts, (begin, end)))
        at, to = starts[here] - begin, ends[here] - begin
        sums = np.zeros(end - begin + 1, U64)
        np.cumsum(folded[data[begin:end]] * powers(end - begin), out=sums[1:])
        hashed[here] = mix((sums[to] - sums[at]) * powers(end - begin, INVERSE)[at] + (to - at).astype(U64))
    return hashed, np.searchsorted(offsets, starts, "right") - 1


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ones run over the end of the array."""
    n = len(words)
    out = np.zeros(n, U64)
    for k in range(size):
        out[: max(0, n - k)] += words[k:] * U64(pow(BASE, k + 1, 1 << 64))
    return mix(out + U64(size))
