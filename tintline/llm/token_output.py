"""Token ids as bit-packed blocks.

The file format: a Parquet table with a row for each block of a shard. Shards
follow one another in the order of doc_id, and so do a shard's blocks and a block's
documents. A block holds whole documents:

    shard int, block int     place in the order
    start long               ids of the shard before this block
    n_ids long, width int    number of ids, and bits of each
    docs binary, has binary  int64 doc_id of each document; bit mask of those not null
    ends binary              int64: past the last id of each document, within the block
    payload binary           ids, ``width`` bits each, least significant bit first

An id's place is width * its number, so any document is read from its block alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shared_folder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Distinct pieces of text that a worker remembers the ids of; the frequent ones come early.
REMEMBERED = 300_000
FORMAT = "shard int, block int, start long, n_ids long, width int, docs binary, has binary, ends binary, payload binary"

#: The pattern that byte-level BPE splits by (words first, which meets the same
#: pieces), for texts of only the characters in PLAIN; other texts are given to the library whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PIECES = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9²³¹¼-¾]+| ?[^\s{LETTERS}0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7E¡-¬®-ɏ–—‘-„…]*")


def byte_letters() -> dict[int, int]:
    """The letters that byte-level BPE writes bytes as: visible ones as themselves, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens added.

    BPE merges never cross the pieces that a text is split into, and texts repeat
    their pieces, so the library's model is asked once for each and a text's ids
    are put together from those. ``ids`` are of 4 bytes each, little-endian.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.model, self.letters = self.library.model, byte_letters()
        self.byte_level = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        got = self.pieces.get(text)
        if got is None:
            tokens = self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
            got = array("I", [t.id for t in tokens]).tobytes()
            if len(self.pieces) < REMEMBERED:
                self.pieces[text] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.byte_level or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        known, piece = self.pieces.get, self.piece
        return b"".join([known(p) or piece(p) for p in PIECES.findall(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end of a block: only the bytes that hold them are looked at."""
    if width == 16:
        return np.frombuffer(payload, "<u2")[begin:end].astype(np.uint32)
    first = begin * width // 8
    held = np.frombuffer(payload, np.uint8)[first : -(-end * width // 8)]
    bits = np.unpackbits(held, bitorder="little")[begin * width - first * 8 :][: (end - begin) * width]
    whole = np.zeros((end - begin, 32), np.uint8)
    whole[:, :width] = bits.reshape(-1, width)
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def _write(path: str, end_id: int, block_ids: int):
    names = [f.split()[0] for f in FORMAT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path), TaskContext.get().partitionId()
        block, start, docs, has, lengths, ids, n = 0, 0, [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = [shard, block, start, len(flat), coder.width, np.array(docs, "<i8").tobytes(), np.packbits(np.array(has, bool)).tobytes(),
                   np.cumsum(lengths).astype("<i8").tobytes(), pack_bits(flat, coder.width)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                doc = batch.column(0)[k].as_py()
                got = np.append(np.frombuffer(coder.encode(batch.column(1)[k].as_py() or ""), np.uint32), np.uint32(end_id))
                docs.append(doc or 0)
                has.append(doc is not None)
                lengths.append(len(got))
                ids.append(got)
                n += len(got)
                if n >= block_ids:
                    yield closed()
                    block, start, docs, has, lengths, ids, n = block + 1, start + n, [], [], [], [], 0
        if docs:
            yield closed()

    return run


def write_tokens(
    docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending doc_id order.

    Null texts count as empty. Null ids come first; rows that share an id are ordered
    by their text. Other columns are not read. ``tokenizer`` is the path of a file of
    the tokenizers library that every executor can open. Ids take the bits that the
    vocabulary needs.

    Documents are range-partitioned by id, so a shard is a range of ids; adaptive
    execution and a large table change the number of shards, not the order.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, "i").sortWithinPartitions("i", "t")
    ordered.mapInArrow(_write(tokenizer, end_id, block_ids), FORMAT).write.mode("overwrite").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["ends"], "<i8")
            starts = np.append(0, ends[:-1])
            has = np.unpackbits(np.frombuffer(row["has"], np.uint8), count=len(ends)).astype(bool)
            crcs = [zlib.crc32(unpack_bits(row["payload"], row["width"], int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(np.frombuffer(row["docs"], "<i8"), mask=~has),
                 pa.array(starts + row["start"]), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_digest(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the ids' crc32."""
    blocks = spark.read.schema(FORMAT).parquet(out)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(shard, doc_id, ids) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<i8")
                has = np.unpackbits(np.frombuffer(row["has"], np.uint8), count=len(ends)).astype(bool)
                flat = unpack_bits(row["payload"], row["width"], 0, row["n_ids"])
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(np.frombuffer(row["docs"], "<i8"), mask=~has), ids],
                    ["shard", "doc_id", "ids"],
                )

    return spark.read.schema(FORMAT).parquet(out).mapInArrow(run, "shard int, doc_id long, ids array<int>")


def token_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/tokens-{uuid4().hex}"
