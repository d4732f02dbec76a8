"""Exact top-k search by inner product, over an impact-ordered index.

Vectors are dealt into shards. In a shard, each dimension's components are quantised to
levels, and the vectors of a level are a posting segment. What a segment can add to a
query's score at most is its impact. A query goes through the segments by descending
impact and adds each to its vectors' scores, so what dimensions not yet met can add to any
vector is at most the next segment's impact for each. That bounds every vector's score
from above. Vectors whose bound is under the k-th best exact score are proved to be no
members; the others are possible members. The search stops when scoring the possible
members exactly costs less than the segments up to the next look, or when no segments
are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a shard, and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Components are quantised by dropping so many bits.
LEVEL_BITS = 2
#: Shares of a shard's postings after which a query looks whether it can stop.
ROUNDS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8)
#: Adding a posting takes about as long as so many components of an exact score (measured).
POSTING_COST = 2
#: The id of a vector without one, which comes after all others in a tie.
NO_ID = np.iinfo(np.int64).max

#: Blocks of queries whose k-th scores a task remembers from one shard to the next.
REMEMBERED = 1024

PACKED = "part long, n int, size int, ids binary, body binary"


def usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, components): floor(scale * x) of each component, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    # beyond this bound an inner product might not fit a long
    most = F.sqrt(F.lit(float(2**62)) / F.greatest(F.size(v), F.lit(1)))
    found = df.filter(v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("components"), most.alias("most"))
    return found.filter(~F.exists("components", lambda x: F.abs(x) > F.col("most"))).select("id", F.col("components").cast("array<long>").alias("components"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows (id, components) as one matrix; shorter vectors are filled up with zeros."""
    ids, flat, sizes = [], [], []
    for batch in batches:
        lists = batch.column(1)
        ids.append(np.asarray(batch.column(0).fill_null(NO_ID)))
        flat.append(np.asarray(lists.flatten()))
        sizes.append(np.asarray(lists.value_lengths()))
    if not ids or not sum(map(len, ids)):
        return
    size = np.concatenate(sizes)
    matrix = np.zeros((len(size), int(size.max())), np.int64)
    matrix[np.arange(matrix.shape[1]) < size[:, None]] = np.concatenate(flat)
    most = int(np.abs(matrix).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    row = [TaskContext.get().partitionId(), *matrix.shape, np.concatenate(ids).astype("<i8").tobytes(), kind.encode() + matrix.astype(kind).tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "n", "size", "ids", "body"])


def packed_vectors(vectors: DataFrame, rows: int, what: str) -> tuple[DataFrame, int]:
    """(part, n, size, ids, body): a matrix of about ``rows`` vectors for each of so many parts.

    They are stored, so that a part is the same when a lost task is run again.
    """
    parts = max(1, -(-vectors.count() // rows))
    return stored(vectors.repartition(parts).mapInArrow(_pack, PACKED), what), parts


def matrix_of(n: int, size: int, ids: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(body, body[:3].decode(), offset=3).reshape(n, size)


@dataclass
class Index:
    """A shard's posting segments: of each dimension, the rows by level."""

    ids: np.ndarray
    matrix: np.ndarray
    largest: int  # greatest size of a component
    values: np.ndarray  # components as doubles
    postings: np.ndarray  # rows, dimension after dimension, by component
    begin: np.ndarray  # of each segment within the postings
    length: np.ndarray
    dim: np.ndarray
    least: np.ndarray  # least and greatest component of a segment
    most: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, matrix: np.ndarray) -> Index:
        n, size = matrix.shape
        order = np.argsort(matrix, axis=0, kind="stable").T
        by = np.take_along_axis(matrix.T, order, axis=1).astype(np.int64).reshape(-1)
        level = by >> LEVEL_BITS
        new = np.ones(len(by), bool)
        new[1:] = level[1:] != level[:-1]
        new[::n] = True
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(by)))
        largest = int(np.abs(matrix.astype(np.int64)).max(initial=0))
        return cls(ids, matrix, largest, matrix.astype(float), order.reshape(-1), begin, length, begin // n, by[begin].astype(float), by[begin + length - 1].astype(float))

    def best(self, own_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows): rows among which are all of the k best with a score of ``floor`` or more."""
        n, size = self.matrix.shape
        if not size:  # empty vectors: all scores are 0
            rows = np.flatnonzero(self.ids != own_id)
            return np.zeros(len(rows)), rows
        whole = np.zeros(size, np.int64)
        whole[: len(query)] = query[:size]
        weights = whole.astype(float)
        greatest = self.largest * int(np.abs(whole).max(initial=0)) * size
        exact = greatest < 1 << 53

        def scores(rows: np.ndarray) -> np.ndarray:
            return self.values[rows] @ weights if exact else self.matrix[rows].astype(np.int64) @ whole

        impact = np.maximum(weights[self.dim] * self.least, weights[self.dim] * self.most)
        order = np.argsort(-impact, kind="stable")
        impact, begin, length = impact[order], self.begin[order], self.length[order]
        past = np.cumsum(length)
        stops = np.unique(np.append(np.searchsorted(past, np.array(ROUNDS) * n * size), len(order)))
        bound, seen, others, done = np.zeros(n), np.zeros(n), self.ids != own_id, 0
        slack = 0.0 if exact else 1e-12 * greatest
        for stop, following in zip(stops.tolist(), [*stops[1:].tolist(), None], strict=True):
            own = slice(done, stop)
            to = np.cumsum(length[own])
            rows = self.postings[np.repeat(begin[own] - to + length[own], length[own]) + np.arange(int(length[own].sum()))]
            bound += np.bincount(rows, np.repeat(impact[own], length[own]), minlength=n)
            seen += np.bincount(rows, minlength=n)
            done = stop
            upper = bound + (size - seen) * (impact[done] if done < len(order) else 0)
            upper[~others] = -np.inf
            if n > 4 * k:  # exact scores of likely members raise the floor
                likely = np.argpartition(-upper, 2 * k)[: 2 * k]
                likely = likely[others[likely]]
                if len(likely) >= k:
                    floor = max(floor, float(np.partition(scores(likely), -k)[-k]))
            possible = np.flatnonzero(upper >= floor - slack) if floor > -np.inf else np.flatnonzero(others)
            if following is None or len(possible) * size <= POSTING_COST * int(past[following - 1] - past[done - 1]):
                break
        return scores(possible), possible


def _tops(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores and their ids, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, part, floors = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if part != row["part"]:  # a shard's rows mostly follow each other
                    index, part = Index.of(*matrix_of(row["n"], row["size"], row["ids"], row["body"])), row["part"]
                ids, queries = matrix_of(row["q_n"], row["q_size"], row["q_ids"], row["q_body"])
                floor = floors.get(row["q_part"], np.full(len(ids), -np.inf))
                if len(floors) < REMEMBERED:
                    floors[row["q_part"]] = floor
                out = []
                for q in range(len(ids)):
                    found, rows = index.best(int(ids[q]), queries[q].astype(np.int64), k, floor[q])
                    scores, members = _tops(found, index.ids[rows], k)
                    if len(scores) == k:
                        floor[q] = max(floor[q], float(scores[-1]))
                    out.append((np.full(len(scores), (row["q_part"] << 32) + q), np.full(len(scores), ids[q]), members, scores.astype(np.int64)))
                uid, query, member, score = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(uid), pa.array(query), pa.array(member, mask=member == NO_ID), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "query_id", "vec_id", "score"])

    return run


def topk_search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k vectors with the highest inner product with each query, exactly.

    Components count as floor(``scale`` * x), with x as double, and missing ones of shorter
    vectors as 0. Vectors that are null or hold a null or non-finite component take no part, and
    neither do those with a component so large that a score might not fit a long (beyond some
    2 ** 28 after scaling, for 64 dimensions). A query's own id is none of its candidates.

    Returns query_id, rank (from 1), vec_id and score; fewer rows than ``k`` if there are fewer
    candidates, none without any. Ties go to smaller ids, a null id being the last. Each row of
    ``queries`` is a query of its own, so repeated rows are answered repeatedly, and repeated
    candidates count repeatedly. Other columns are not read.

    Every block of ``block_rows`` queries goes once to every shard of ``shard_rows`` vectors, as
    packed rows that are dealt out by shard; a shard answers a query with k rows at most, whatever is
    frequent. The work is queries times vectors, which an exact search can only shorten by its bounds.
    """
    shards, n = packed_vectors(usable(vectors, id_col, vector_col, scale), shard_rows, "shards")
    blocks, _ = packed_vectors(usable(queries, id_col, vector_col, scale), block_rows, "queries")
    asked = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
    found = shards.join(asked, "part").mapInArrow(_searched(k), "uid long, query_id long, vec_id long, score long")
    by = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
