"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles, hashed to 64 bits. In the sketch
of a size band every shingle flips one bit: its leading bits name one of the
band's lanes, the rest the bit in it. Of a lane only the XOR of its shingles'
random words is kept, which is the same for the same bits. Two sets with a
symmetric difference of d differ in d bits and so in d lanes at most: the
distance of the sketches is a lower bound. Sets of sizes a <= b that link have
d <= (a + b) / 7 <= a / 3 at a similarity of 0.75, so, by pigeonhole, any
floor(a / 3) + 1 of a set's filled lanes, first in an order that all sets share,
have one in common with those of a partner. The order is by how many documents
have the lane's value, rarest first. Lanes that no other document has need not be
sent; a document with more of those than it may miss has no partner. Where a
passage is in very many documents, its lanes come last and are hardly ever sent.

Of the documents that share a lane's value one, the hub, is compared with all the
others: the one with the least share of lanes of its own, which in a group of near
copies is the original or close to it. What is still apart then is compared with
the rest where a dense sketch of SKETCH_BITS bits allows: that two of those differ
in more bits than linked sets may have shingles of their own rules a pair out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .graph import components
from .packed import (
    U64,
    Chunk,
    binary_buffers,
    chunk_rows,
    mix,
    pack_docs,
    ranges_for,
    squeeze,
    sums_of,
    unpack_docs,
    unsqueeze,
    window_hashes,
    with_counts,
    word_hashes,
)

#: Sets below this size share the first band, whose lanes are so many that shingles hardly meet.
SMALL, SMALL_LANES = 64, 20
#: Lanes (of both bands) for each byte of text, to size the hash ranges.
LANES_PER_BYTE = 0.12
#: Pairs of a hub that meet in one place; hubs of more up to which their list is broadcast (beyond, it is joined by shuffles).
HUB_PAIRS, SMALL_HUBS = 128, 10_000
#: Bits of the dense sketch.
SKETCH_BITS = 1024
ROW = "uid long, doc_id long, n long, own long, sig_a long, sig_b long, keys array<long>, sketch array<long>, body binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    words, doc = word_hashes(data, offsets)
    ends = np.searchsorted(doc, np.arange(len(offsets)))
    windows = window_hashes(words, size)
    out = []
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        if end - begin >= size:
            out.append(np.unique(windows[begin : end - size + 1]))
        else:
            few = words[begin:end]
            out.append(window_hashes(few, len(few))[:1] if len(few) else few)
    return out


def lanes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filled lanes of all sets: their values, the set, and the band.

    Band j >= 6 has 2**j lanes and is home to sets of 2**j to 2**(j + 1) - 1; a set is
    also in each higher band whose least size a partner at ``percent`` can have.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.concatenate(sets)
    home = np.where(sizes < SMALL, 5, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    random = mix(flat + U64(0x5851F42D4C957F2D))
    out = []
    for up in range(64):
        band = home + up
        member = (sizes > 0) & ((up == 0) | (100 * sizes >= percent * 2**band))
        if not member.any():
            break
        of = np.repeat(np.arange(len(sets)), np.where(member, sizes, 0))
        mine = np.repeat(member, sizes)
        bits = np.where(band == 5, SMALL_LANES, band)[of].astype(U64)
        lane = flat[mine] >> (U64(64) - bits)
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (lane[1:] != lane[:-1])))
        value = np.bitwise_xor.reduceat(random[mine], first)
        of, lane = of[first], lane[first]
        out.append((mix(value + mix(lane * U64(64) + band[of].astype(U64))), of, band[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dense_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the shingles at each of SKETCH_BITS bits, as 64-bit integers."""
    odd = np.bincount((hashes & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


LONGS = pa.list_(pa.int64())


def _allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """Most lanes that a set of n can differ in from a partner at ``percent`` or more."""
    return n * (100 - percent) // percent


def _features(size: int, percent: int, ranges):
    return lambda chunk: ranges.cut(lanes(shingle_sets(chunk.data, chunk.offsets, size), percent)[0])


def _choose(size: int, percent: int, ranges):
    """Each document's size, identity and the lanes to join on; its text only if there are such."""

    def choose(chunk: Chunk, sums: np.ndarray) -> pa.RecordBatch:
        sets = shingle_sets(chunk.data, chunk.offsets, size)
        n = np.array([len(x) for x in sets], np.int64)
        values, of, band = lanes(sets, percent)
        values = ranges.cut(values)
        df = sums[np.searchsorted(np.unique(values), values)] if len(values) else sums
        keys: list[list[int]] = [[] for _ in sets]
        group = of * 64 + band
        groups, slot = np.unique(group, return_inverse=True)
        allowed = _allowed(n[groups // 64], percent) if len(groups) else groups
        filled, alone = np.bincount(slot, minlength=len(groups)), np.bincount(slot[df == 1], minlength=len(groups))
        # fewer filled lanes than may differ: its partner may have others, so these also meet each other
        for g in np.flatnonzero(filled <= allowed):
            keys[groups[g] // 64].append(-1 - int(groups[g] % 64))
        need = np.maximum(0, allowed + 1 - alone)
        live = np.flatnonzero((need[slot] > 0) & (df > 1))
        order = live[np.lexsort((values[live], df[live], slot[live]))]
        rank = np.arange(len(order)) - np.searchsorted(slot[order], slot[order], "left")
        for k in order[rank < need[slot[order]]]:
            keys[of[k]].append(int(values[k]) >> 1)
        own = np.zeros(len(sets), np.int64)
        own[groups // 64] = 1_000_000 * alone // filled
        mixed = (mix(x) for x in sets)
        sig = [(int(x.sum(dtype=U64)) >> 1, int(np.bitwise_xor.reduce(mix(x + U64(1)))) >> 1) if len(x) else (0, 0) for x in mixed]
        body = [squeeze(chunk.text(i).tobytes()) if k else None for i, k in enumerate(keys)]
        dense = [dense_sketch(x) if k else None for x, k in zip(sets, keys, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk.uids), chunk.id_array(), pa.array(n), pa.array(own), pa.array([a for a, _ in sig], pa.int64()),
             pa.array([b for _, b in sig], pa.int64()), pa.array(keys, LONGS), pa.array(dense, LONGS), pa.array(body, pa.binary())],
            ["uid", "doc_id", "n", "own", "sig_a", "sig_b", "keys", "sketch", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in chunk_rows(batches):
            yield choose(chunk, sums_of(row))

    return run


def _verified(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are at least ``percent`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> list[np.ndarray]:
            texts = pa.array([unsqueeze(x.as_py()) for x in column], pa.large_binary())
            at, data = binary_buffers(texts)
            return shingle_sets(data, at, size)

        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                keep = []
                for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # the first of a pair is the one that many pairs share: its pairs are dealt out by salt, its text sent once for each
    pairs = checkpointed(pairs)
    hubs = checkpointed(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts")).filter("parts > 1"))
    if hubs.limit(SMALL_HUBS + 1).count() <= SMALL_HUBS:
        hubs = F.broadcast(hubs)
    salt = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("salt")
    salted = pairs.join(hubs, "u", "left").select("u", "v", salt)
    first = salted.select("u", "salt").distinct().join(bodies.select(F.col("uid").alias("u"), F.col("body").alias("bu")), "u")
    named = salted.join(bodies.select(F.col("uid").alias("v"), F.col("body").alias("bv")), "v").join(first, ["u", "salt"])
    return named.select("u", "v", "bu", "bv").mapInArrow(run, "u long, v long")


def _links(kept: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (u, v) with the same connected components as the links between different sets."""
    bodies = kept.filter("body IS NOT NULL").select("uid", "body")
    keyed = kept.select("uid", "n", "own", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("own", "uid", "n")).alias("hub")).filter("c > 1")
    # written as a table, so that the join has shuffles of its own, whose large partitions Spark splits
    buckets = stored(buckets.select("key", "c", F.col("hub.uid").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    members = checkpointed(keyed.join(buckets, "key").select("key", "uid", "n", "c", "hub", "hub_n"))
    near = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    # first each bucket's hub against all others of it
    stars = members.filter("uid != hub").filter(near.format("n", "hub_n")).select(F.col("hub").alias("u"), F.col("uid").alias("v")).distinct()
    first = checkpointed(_verified(stars, bodies, size, percent))
    # then what is still apart within a bucket: all members but those of its largest component, against all
    roots = components(first)
    member = members.filter("c > 2").join(roots, F.col("uid") == F.col("node"), "left").select("key", "uid", "n", "hub", F.coalesce("root", "uid").alias("comp"))
    sides = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("giant"), F.count(F.lit(1)).alias("sides")
    ).filter("sides > 1")
    split = member.filter("uid != hub").join(stored(sides, "sides"), "key").join(kept.select("uid", "sketch"), "uid")
    words = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_BITS // 64)]
    split = checkpointed(split.select("key", "uid", "n", "comp", "giant", *words))
    names = {"uid": "a", "n": "an", "comp": "ac"} | {f"s{k}": f"t{k}" for k in range(SKETCH_BITS // 64)}
    light = split.filter("comp != giant").drop("giant").withColumnsRenamed(names)
    distance = " + ".join(f"bit_count(s{k} ^ t{k})" for k in range(SKETCH_BITS // 64))
    apart = (
        light.join(split, "key")
        .filter("comp != ac AND (comp = giant OR a < uid)")
        .filter(near.format("n", "an"))
        .filter(f"{100 + percent} * ({distance}) <= {100 - percent} * (n + an)")
    )
    apart = apart.select(F.greatest("a", "uid").alias("u"), F.least("a", "uid").alias("v")).distinct()
    return first.unionByName(checkpointed(_verified(apart, bodies, size, percent)))


def _grouped(chunks: DataFrame, size: int, percent: int) -> DataFrame:
    ranges = ranges_for(chunks, LANES_PER_BYTE)
    rows = checkpointed(with_counts(chunks, _features(size, percent, ranges), ranges).mapInArrow(_choose(size, percent, ranges), ROW))
    # equal sets are one node, their least row
    same = rows.filter("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least_id"))
    same = checkpointed(same)
    nodes = rows.join(same.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "n", "own", "keys", "sketch", "body")
    roots = checkpointed(components(_links(nodes, size, percent)))
    comp = same.join(roots, F.col("rep") == F.col("node"), "left").select("sig_a", "sig_b", "n", "least_id", F.coalesce("root", "rep").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = comp.join(least, "comp").select("sig_a", "sig_b", "n", "comp", "component_id")
    return rows.select("uid", "doc_id", "n", "sig_a", "sig_b").join(named, ["sig_a", "sig_b", "n"], "left").select(
        "uid",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("comp", "uid").alias("comp"),
    )


def jaccard_join(
    docs: DataFrame, shingle_words: int = 5, min_percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group the documents that are linked by a shingle similarity of ``min_percent`` or more.

    Words are runs of anything but white space, with A-Z as a-z. A text's set is its
    distinct shingles of ``shingle_words`` words; a shorter text is one shingle;
    a null or blank text has none and is linked with nothing. Two documents link when
    100 * shared >= min_percent * all of their shingles.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the least
    doc_id reachable over links). Every row is a document, also where ids repeat. A
    null id counts as larger than any; a component of null ids has a null id. Other
    columns are not read. Sets are of 64-bit hashes; candidates are verified on the
    whole texts.
    """
    return _grouped(pack_docs(docs, id_col, text_col), shingle_words, min_percent).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(
    docs: DataFrame, shingle_words: int = 5, min_percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` but those linked to one that stays: the least doc_id of each group."""
    chunks = pack_docs(docs, id_col, text_col, whole=True)
    grouped = _grouped(chunks, shingle_words, min_percent)
    keep = grouped.groupBy("comp").agg(F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("uid"))
    return unpack_docs(chunks, keep, docs, text_col)
