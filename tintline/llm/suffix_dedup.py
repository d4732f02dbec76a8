"""Suffix-array dedup: remove the bytes of strings that stand in two places or more.

A suffix array over every byte of the corpus would be some 200 bytes of sorting
for each byte of text. Most of it can't matter: a 200-byte window names as its anchor
the 32-byte gram in it with the least hash, so equal windows have equal anchors, and
windows whose anchor stands in one place only are unique. So the index is a sparse
suffix array: of all suffixes it holds those that begin with an anchor, in the order of
the anchors' hashes, as a bucketed and sorted table of the warehouse. New batches get
such an array each, are merge-joined with those of all levels, without a shuffle, and
levels of the same rank merge into one of the next. ``SuffixIndex`` keeps the levels, so
documents that come later meet those that came before.

The long matches behind equal anchors are decided on bytes. Neighbouring windows with
the same anchor form a stretch. Stretches that are equal as a whole, by a 128-bit
cryptographic digest, are repeated as a whole; one of them goes on with those of the
same anchor that differ, to shards that sort all their windows and compare neighbours.
Stretches of a hot anchor go there in pieces of a few windows, dealt by the bytes that
all windows of a piece have in common, and where very many pieces share those, window
by window, dealt by all bytes: equal windows still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .decontaminate import merged
from .packed import INVERSE, U64, Chunk, _tables, binary_buffers, chunk_rows, mix, pack_docs, powers

#: Bytes of the gram that a window's anchor is.
GRAM = 32
#: Low bits of a gram's hash that give way to its place, so that the first of equal hashes is
#: taken; the same for all texts, as equal windows must have the same anchor.
PLACE_BITS = U64(31)
#: Text of a chunk, in bytes: finding its stretches takes some 40 times as much memory.
CHUNK_BYTES = 1 << 20
#: Batches that a table of documents is added to the index in.
BATCHES = 4
#: Windows that a shard is to hold, and stretches that are compared at once.
SHARD_WINDOWS, BATCH_STRETCHES = 200_000, 500
#: Stretches of an anchor that has this many different ones are dealt out in pieces of so many windows.
HOT_ANCHOR, PIECE = 256, 8
#: Where more pieces than this share their common bytes, their windows are dealt out one by one.
HOT_PIECES = 2_000
STRETCH_ROW = "anchor long, d0 long, d1 long, chunk long, places array<int>, n int, lead int"
SENT_ROW = "key long, uid long, begin long, known boolean, lead long, body binary"
PIECE_ROW = "key long, uid long, begin long, end long, flags binary, body binary"
#: A window's flag in a piece: open, repeated for sure, or that and sent by another piece.
OPEN, KNOWN, TOLD = 0, 1, 2


class Stretches:
    """A chunk's stretches: begin (byte of the chunk), windows, and the anchor's place and hash."""

    def __init__(self, chunk: Chunk, width: int) -> None:
        data, n = chunk.data, len(chunk.data)
        self.begin = self.windows = self.place = np.empty(0, np.int64)
        self.anchor = np.empty(0, U64)
        if n < width:
            return
        plain, _, _ = _tables()
        sums = np.zeros(n + 1, U64)
        np.cumsum(plain[data] * powers(n), out=sums[1:])
        back = powers(n, INVERSE)
        grams = sums[GRAM:] - sums[: n - GRAM + 1]
        grams *= back[: n - GRAM + 1]
        # the least (hash, place) of each window's grams: running minima within blocks, from both ends
        w, low = width - GRAM + 1, PLACE_BITS
        blocks = np.full(-(-len(grams) // w) * w, np.iinfo(U64).max, U64)
        keys = blocks[: len(grams)]
        keys[:] = mix(grams)
        del grams
        keys >>= low
        keys <<= low
        keys |= np.arange(len(keys), dtype=U64)
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        np.minimum.accumulate(blocks[:, ::-1], axis=1, out=blocks[:, ::-1])
        starts = n - width + 1
        least = np.minimum(blocks.ravel()[:starts], ahead[w - 1 : w - 1 + starts])
        del keys, blocks, ahead
        inside = np.zeros(n + 1, np.int64)
        long = np.diff(chunk.offsets) >= width
        np.add.at(inside, chunk.offsets[:-1][long], 1)
        np.add.at(inside, chunk.offsets[1:][long] - width + 1, -1)
        inside = np.cumsum(inside)[:starts] > 0
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= (least[1:] != least[:-1]) | ~inside[1:]
        self.begin = np.flatnonzero(new)
        self.windows = np.flatnonzero(last) - self.begin + 1
        self.place = (least[self.begin] & ((U64(1) << low) - U64(1))).astype(np.int64)
        self.anchor = mix(mix((sums[self.place + GRAM] - sums[self.place]) * back[self.place]) + U64(1)) >> U64(1)


def _anchors(width: int, batches_of: int):
    """The different anchors of each chunk, with the number of their stretches, and the chunk's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunk_rows(batches):
            values, counts = np.unique(Stretches(chunk, width).anchor, return_counts=True)
            same = [np.full(len(values), x) for x in (chunk.number % batches_of, chunk.number)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(same[0], pa.int32()), pa.array(values.astype(np.int64)), pa.array(same[1], pa.int64()), pa.array(counts, pa.int32())],
                ["batch", "anchor", "chunk", "n"],
            )

    return run


def _digested(width: int):
    """The different stretches behind a chunk's listed anchors, with all their places in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in chunk_rows(batches):
            found, listed = Stretches(chunk, width), np.array(row["anchors"], np.int64)
            rows: dict[tuple, list] = {}
            for k in np.flatnonzero(np.isin(found.anchor.astype(np.int64), listed)):
                begin, n = int(found.begin[k]), int(found.windows[k])
                digest = hashlib.blake2b(chunk.data[begin : begin + n + width - 1], digest_size=16).digest()
                one = rows.setdefault((int(found.anchor[k]), digest), [[], n, int(found.place[k]) - begin])
                one[0].append(begin)
            halves = np.frombuffer(b"".join(d for _, d in rows), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in rows], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.full(len(rows), chunk.number)),
                 pa.array([x[0] for x in rows.values()], pa.list_(pa.int32())), pa.array([x[1] for x in rows.values()], pa.int32()),
                 pa.array([x[2] for x in rows.values()], pa.int32())],
                [f.split()[0] for f in STRETCH_ROW.split(", ")],
            )

    return run


def _with_bytes(width: int):
    """Listed stretches of each chunk with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in chunk_rows(batches):
            listed = row["listed"]
            for k in range(0, len(listed), 4 * BATCH_STRETCHES):
                part = listed[k : k + 4 * BATCH_STRETCHES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["key"] for x in part], pa.int64()), pa.array([chunk.number] * len(part)), pa.array([x["begin"] for x in part], pa.int64()),
                     pa.array([x["known"] for x in part]), pa.array([x["lead"] for x in part], pa.int64()),
                     pa.array([chunk.data[x["begin"] : x["begin"] + x["n"] + width - 1].tobytes() for x in part], pa.binary())],
                    [f.split()[0] for f in SENT_ROW.split(", ")],
                )

    return run


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def repeated_windows(bodies: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows of texts (bytes and offsets), as suffixes cut to ``width``, and compare neighbours.

    For each window, numbered text after text: whether it stands twice or more, and
    whether it is the first of its equals.
    """
    counts = np.diff(at) - width + 1
    starts = np.repeat(at[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(bodies, width)[starts]).view(f"V{width}").ravel()
    order = np.argsort(suffixes.view(f"S{width}"), kind="stable")
    new = np.append(True, suffixes[order[1:]] != suffixes[order[:-1]])[: len(order)]
    twice = ~(new & np.append(new[1:], True)[: len(new)])
    repeated, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeated[order], first[order] = twice, new
    return repeated, first


def _runs(hit: np.ndarray, row: np.ndarray, counts: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the windows ``hit`` within a text: its row, and the bytes from begin to end."""
    new = np.append(True, (np.diff(hit) > 1) | (np.diff(row[hit]) > 0))[: len(hit)]
    first, last = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
    base = begin[row[first]] - (np.cumsum(counts) - counts)[row[first]]
    return row[first], base + first, base + last + width


def _pieces(width: int):
    """Stretches of hot anchors in pieces, and (without a body) the spans repeated among them.

    Of equal windows in a batch of stretches one stands for all. Equal windows have
    their anchor in the same place, so pieces are cut by that. A piece's key is the hash of
    the bytes that every window at its distance from the anchor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, _, _ = _tables()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_STRETCHES):
                batch = whole.slice(start, BATCH_STRETCHES)
                uid, begin, lead = (np.asarray(batch.column(c)) for c in ("uid", "begin", "lead"))
                at, data = binary_buffers(batch.column("body"))
                at, data = at - at[0], data[at[0] : at[-1]]
                repeated, leads = repeated_windows(data, at, width)
                counts = np.diff(at) - width + 1
                row = np.repeat(np.arange(len(counts)), counts)
                known = (np.asarray(batch.column("known").cast(pa.int8())) > 0)[row]
                flags = np.full(len(row), TOLD, np.uint8)
                flags[leads] = KNOWN
                flags[~repeated & ~known] = OPEN
                i = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
                piece = (lead[row] - i) // PIECE
                first = np.flatnonzero(np.append(True, (np.diff(row) > 0) | (np.diff(piece) != 0)))
                past = np.append(first[1:], len(row))
                fresh = np.flatnonzero(np.minimum.reduceat(flags, first) < TOLD)
                first, past = first[fresh], past[fresh]
                of, piece = row[first], piece[first]
                sums = np.zeros(len(data) + 1, U64)
                np.cumsum(plain[data] * powers(len(data)), out=sums[1:])
                a = at[of] + lead[of] - piece * PIECE
                core = (sums[a + width - PIECE + 1] - sums[a]) * powers(len(data) + 1, INVERSE)[a]
                key = mix(mix(core) + piece.astype(U64)) >> U64(1)
                text, low = data.tobytes(), at[of] + i[first]
                bodies = [text[b : b + n + width - 1] for b, n in zip(low.tolist(), (past - first).tolist(), strict=True)]
                marks = [flags[b:e].tobytes() for b, e in zip(first, past, strict=True)]
                own, span_begin, span_end = _runs(np.flatnonzero(repeated & ~known), row, counts, begin, width)
                none = [None] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*key.astype(np.int64).tolist(), *none], pa.int64()),
                        pa.array(np.concatenate([uid[of], uid[own]])),
                        pa.array(np.concatenate([begin[of] + i[first], span_begin])),
                        pa.array([*[None] * len(first), *span_end.tolist()], pa.int64()),
                        pa.array([*marks, *none], pa.binary()),
                        pa.array([*bodies, *none], pa.binary()),
                    ],
                    ["key", "uid", "begin", "end", "flags", "body"],
                )

    return run


def _dealt(pieces: DataFrame, width: int) -> DataFrame:
    """The pieces, and instead of those with very common keys their windows."""
    many = F.broadcast(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_PIECES).select("key"))
    split = pieces.join(many, "key", "left_semi").select("uid", "begin", "flags", "body", F.explode(F.expr("sequence(0, length(flags) - 1)")).alias("i"))
    split = split.select(
        "uid", (F.col("begin") + F.col("i")).alias("begin"), F.expr("substring(flags, i + 1, 1)").alias("flags"), F.expr(f"substring(body, i + 1, {width})").alias("body")
    ).filter(F.col("flags") != F.lit(bytes([TOLD])))
    windows = split.select(F.xxhash64("body").alias("key"), "uid", "begin", "flags", "body")
    return pieces.join(many, "key", "left_anti").select(windows.columns).unionByName(windows)


def _shard(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, flags, bodies = [], [], []
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_STRETCHES):
                batch = whole.slice(begin, BATCH_STRETCHES)
                at, data = binary_buffers(batch.column("body"))
                bodies.append((data[at[0] : at[-1]], np.diff(at)))
                counts = np.diff(at) - width + 1
                # one flag for each window, or one for all
                mark_at, marks = binary_buffers(batch.column("flags"))
                marks = marks[mark_at[0] : mark_at[-1]]
                lengths = np.diff(mark_at)
                marks = np.repeat(marks, np.repeat(np.where(lengths == counts, 1, counts), lengths))
                rows.append((np.asarray(batch.column("uid")), np.asarray(batch.column("begin")), counts))
                flags.append(marks)
        uid, begin, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.append(0, np.cumsum(np.concatenate([x for _, x in bodies])))
        repeated, _ = repeated_windows(np.concatenate([x for x, _ in bodies]), at, width)
        hit = np.flatnonzero(repeated & (np.concatenate(flags) == OPEN))
        if not len(hit):
            return
        of, first, past = _runs(hit, row, counts, begin, width)
        yield pa.RecordBatch.from_arrays([pa.array(uid[of]), pa.array(first), pa.array(past)], ["uid", "begin", "end"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, row in chunk_rows(batches):
        spans = sorted((s["begin"], s["end"]) for s in row["spans"] or ())
        begins = np.array([a for a, _ in spans], np.int64)
        kept, listed = [], []
        for low, high in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
            own = merged([(a - low, b - low) for a, b in spans[np.searchsorted(begins, low) : np.searchsorted(begins, high)]])
            ends = [0, *(x for s in own for x in s), high - low]
            text = chunk.data[low:high].tobytes()
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            listed.append([{"begin": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [chunk.id_array(), pa.array(np.diff(chunk.offsets)), pa.array(listed, SPANS), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


class SuffixIndex:
    """Documents and the sparse suffix arrays of their anchors, in levels that grow geometrically.

    A level is a table of the warehouse (anchor, chunk, n), bucketed and sorted by anchor;
    texts are in chunks in the shared folder. ``add`` merge-joins a new batch with
    all levels; ``result`` judges all documents that were added so far. ``drop`` removes the
    levels' tables.
    """

    def __init__(self, spark: SparkSession, width: int = 200) -> None:
        if width < GRAM:
            raise ValueError(f"width: at least {GRAM}")
        self.spark, self.width = spark, width
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.chunks: list[DataFrame] = []
        self.matched: list[DataFrame] = []

    def add(self, docs: DataFrame, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the rows of ``docs``, as so many batches."""
        chunks = pack_docs(docs, id_col, text_col, limit=CHUNK_BYTES, first=len(self.chunks) << 40)
        self.chunks.append(chunks)
        found = stored(chunks.mapInArrow(_anchors(self.width, batches), "batch int, anchor long, chunk long, n int"), "anchors")
        for k in range(batches):
            self._merge()
            self._enter(self._sorted(found.filter(F.col("batch") == k).drop("batch")))

    def _sorted(self, entries: DataFrame) -> str:
        name = f"suffix_level_{uuid4().hex}"
        dealt = entries.repartition(self.buckets, "anchor")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return name

    def _merge(self) -> None:
        """Levels of the same rank become one of the next."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._sorted(self.spark.table(a).unionByName(self.spark.table(b)))))
            for old in (a, b):
                self.spark.sql(f"DROP TABLE {old}")

    def _enter(self, name: str) -> None:
        """Find the batch's anchors in its own array and those of all levels; it becomes a level."""
        new, hits = self.spark.table(name), []
        held = new.groupBy("anchor").agg(F.sum("n").alias("c"))
        seen = held
        for k, (_, level) in enumerate(self.levels):
            old = self.spark.table(level)
            hits.append(old.join(held.select("anchor"), "anchor", "left_semi").select("chunk", "anchor"))
            counts = old.groupBy("anchor").agg(F.sum("n").alias(f"c{k}"))
            seen = seen.join(counts, "anchor", "left").withColumn("c", F.col("c") + F.coalesce(f"c{k}", F.lit(0))).drop(f"c{k}")
        found = new.join(seen.filter("c > 1").select("anchor"), "anchor", "left_semi").select("chunk", "anchor")
        for more in hits:
            found = found.unionByName(more)
        self.matched.append(stored(found, "matched"))
        self.levels.append((0, name))

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []

    def spans(self) -> DataFrame:
        """(chunk, begin, end): bytes of chunks that are covered by repeated windows; runs may overlap."""
        width, chunks, matched = self.width, _union(self.chunks), _union(self.matched)
        listed = matched.groupBy(F.col("chunk").alias("of")).agg(F.collect_set("anchor").alias("anchors"))
        found = stored(chunks.join(listed, F.col("chunk") == F.col("of")).drop("of").mapInArrow(_digested(width), STRETCH_ROW), "stretches")
        # stretches that are equal as a whole: one row for each, however many chunks have it
        same = ["anchor", "d0", "d1"]
        bodies = found.groupBy(*same).agg(
            F.sum(F.size("places")).alias("copies"), F.min(F.struct("chunk", F.col("places")[0].alias("begin"))).alias("at"),
            F.first("n").alias("n"), F.first("lead").alias("lead"),
        )
        bodies = stored(bodies, "bodies")
        twice = found.join(bodies.filter("copies > 1").select(same), same, "left_semi").select("chunk", "n", F.explode("places").alias("begin"))
        twice = twice.select("chunk", F.col("begin").cast("long").alias("begin"), (F.col("begin") + F.col("n") + (width - 1)).cast("long").alias("end"))
        # one of each that has others beside it goes to the shards
        varied = bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        lead = F.when(F.col("kinds") >= HOT_ANCHOR, F.col("lead")).otherwise(-1)
        sent = stored(bodies.join(varied, "anchor").select(F.col("anchor").alias("key"), "at.*", "n", (F.col("copies") > 1).alias("known"), lead.alias("lead")), "sent")
        windows = sent.agg(F.sum(F.when(F.col("lead") < 0, F.col("n")))).first()[0] or 0
        hot = stored(self._bytes_of(sent.filter("lead >= 0")).drop("key").mapInArrow(_pieces(width), PIECE_ROW), "pieces")
        windows += hot.agg(F.sum(F.length("flags"))).first()[0] or 0
        flags = F.when(F.col("known"), F.lit(bytes([KNOWN]))).otherwise(F.lit(bytes([OPEN])))
        cold = self._bytes_of(sent.filter("lead < 0")).select("key", "uid", "begin", flags.alias("flags"), "body")
        shards = max(1, int(windows // SHARD_WINDOWS) + 1)
        parts = cold.unionByName(_dealt(hot.filter("body IS NOT NULL"), width)).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        spans = parts.groupBy("shard").applyInArrow(_shard(width), "uid long, begin long, end long")
        spans = spans.unionByName(hot.filter("body IS NULL").select("uid", "begin", "end"))
        return spans.select(F.col("uid").alias("chunk"), "begin", "end").unionByName(twice)

    def _bytes_of(self, sent: DataFrame) -> DataFrame:
        wanted = sent.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("key", "begin", "n", "known", "lead")).alias("listed"))
        return _union(self.chunks).join(wanted, F.col("chunk") == F.col("of")).drop("of").mapInArrow(_with_bytes(self.width), SENT_ROW)

    def result(self) -> DataFrame:
        """doc_id, n_bytes, spans and kept of every document that was added."""
        back = self.spans().groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        whole = _union(self.chunks).join(back, F.col("chunk") == F.col("of"), "left").drop("of")
        return whole.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts anywhere else.

    Texts are their UTF-8 bytes; matches don't cross documents but may overlap and
    may be within one document. Strings are judged on the input.

    Returns one row per row of ``docs``: doc_id, n_bytes, spans (maximal removed runs, as
    [begin, end) bytes) and kept (the remaining bytes). A null text is empty. Every row
    is a document, so of rows that repeat all bytes of a text of ``width`` bytes or more
    are removed. Null ids are like others; other columns are not read. A very long text
    is one chunk and is searched by one task.

    64-bit hashes only pick what is compared; stretches count as equal by a digest of
    128 bits that nobody knows how to make collide, and windows by their bytes. A
    passage in very many documents is one row for each chunk at most.
    """
    index = SuffixIndex(docs.sparkSession, width)
    index.add(docs, batches, id_col, text_col)
    index.drop()
    return index.result()
