"""Stretches of a text that repeat with a period, found by probing harmonic grids.

A stretch of ``m`` periods p or more holds m or more points of the grid 0, p, 2p, ..., in
whichever place it begins, so m - 1 neighbouring pairs of points must be equal words. All
grids together have n / 1 + n / 2 + ... points, so a text costs n log n comparisons, and
few points survive. Those are extended word by word, in chunks that grow, to the whole
stretch. Points within runs that are known already, of periods that divide p, are skipped:
there the stretch is that run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a run at least, and how often a run holds its period at least.
MIN_WORDS, MIN_REPEATS = 6, 4
#: Bytes of text after which a batch is handed on.
SLICE_BYTES = 4 << 20


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _probed(ids: np.ndarray, repeats: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, grid points j) by ascending p for which words jp, (j + 1)p, ... are equal ``repeats`` times.

    Short periods are probed each on its grid; long ones, which have few points, all at
    once, grid point by grid point.
    """
    n, root = len(ids), min(longest, isqrt(len(ids)))
    for p in range(1, root + 1):
        grid = ids[::p]
        same = grid[1:] == grid[:-1]
        all_same = same[: len(same) - repeats + 2].copy()
        for t in range(1, repeats - 1):
            all_same &= same[t : t + len(all_same)]
        if all_same.any():
            yield p, np.flatnonzero(all_same)
    found_p, found_j = [], []
    for j in range(n // (root + 1)):
        periods = np.arange(root + 1, min(longest, (n - 1) // (j + repeats - 1)) + 1)
        if not len(periods):
            break
        at = ids[j * periods]
        for t in range(1, repeats):
            equal = ids[(j + t) * periods] == at
            periods, at = periods[equal], at[equal]
            if not len(periods):
                break
        found_p.append(periods)
        found_j.append(np.full(len(periods), j))
    if not found_p:
        return
    p, j = np.concatenate(found_p), np.concatenate(found_j)
    order = np.lexsort((j, p))
    p, j = p[order], j[order]
    edges = np.flatnonzero(np.diff(p)) + 1
    for own_p, own_j in zip(np.split(p, edges), np.split(j, edges), strict=True):
        if len(own_p):
            yield int(own_p[0]), own_j


def _thinned(ids: np.ndarray, p: int, points: np.ndarray, repeats: int) -> np.ndarray:
    """The points behind which further words, too, are equal one period on, as within a run they must be."""
    for part in (1, 3, 2):
        offset = max(1, part * (repeats - 2) * p // 4)
        if offset <= (repeats - 2) * p and len(points) > 4:
            at = points * p + offset
            points = points[ids[at] == ids[at + p]]
    return points


def _uncovered(p: int, points: np.ndarray, runs: list[tuple[int, int]], n: int) -> np.ndarray:
    """The points j whose pair jp, (j + 1)p isn't within one of the runs [begin, past)."""
    begin, past = np.array(runs).T
    first, after = -(-begin // p), (past - 1) // p
    inside = np.zeros(n // p + 2, np.int64)
    np.add.at(inside, first, first < after)
    np.add.at(inside, after, -(first < after).astype(np.int64))
    return points[np.cumsum(inside)[points] == 0]


def _stretch(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """[begin, past): the longest stretch around i in which words p apart are equal, as words i and i + p are."""
    n, step, past = len(ids), 32, i
    while past < n - p:
        there = ids[past + p : past + p + step]
        other = ids[past : past + len(there)] != there
        if other.any():
            past += int(other.argmax())
            break
        past, step = past + len(there), step * 2
    begin, step = i, 32
    while begin > 0:
        low = max(0, begin - step)
        other = ids[low:begin] != ids[low + p : begin + p]
        if other.any():
            begin = low + int(np.flatnonzero(other)[-1]) + 1
            break
        begin, step = low, step * 2
    return begin, past + p


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by start, then period."""
    n, longest = len(ids), len(ids) // min_repeats
    found: list[tuple[int, int, int]] = []
    if n < min_words:
        return found
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, points in _probed(ids, min_repeats, longest):
        if p in known:
            points = _uncovered(p, points, known.pop(p), n)
        points, k = _thinned(ids, p, points, min_repeats), 0
        while k < len(points):
            begin, past = _stretch(ids, int(points[k]) * p, p)
            # other pairs of this grid in the stretch are of the same stretch
            k = max(k + 1, int(np.searchsorted(points, -(-past // p) - 1)))
            if past - begin >= max(min_words, min_repeats * p):
                found.append((begin, past - begin, p))
                for multiple in range(2 * p, min(longest, past - begin - 1) + 1, p):
                    known[multiple].append((begin, past))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run only its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


FIELDS = ("start", "length", "period")
RUN = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def _judged(min_words: int, min_repeats: int):
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, counts, runs, texts, size = 0, [], [], [], 0
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or b"").split()
                own = runs_of(word_numbers(words), min_words, min_repeats)
                kept = collapsed(len(words), own) if own else None
                text = b" ".join(words if kept is None else [words[i] for i in np.flatnonzero(kept)])
                counts.append(len(words))
                runs.append([dict(zip(FIELDS, r, strict=True)) for r in own])
                texts.append(text)
                size += len(text)
                if size >= SLICE_BYTES or k == batch.num_rows - 1:
                    whole = batch.column(0).slice(begin, k + 1 - begin)
                    columns = [whole, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "runs", "collapsed"])
                    begin, counts, runs, texts, size = k + 1, [], [], [], 0

    return run


def periodic_runs(docs: DataFrame, text: Column | str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Find the stretches of words that repeat with a period, and the texts without the repeats.

    Words are runs of anything but white space, numbered from 0. A run is a stretch of
    at least ``min_words`` words and ``min_repeats`` (2 or more) times its smallest period q, in
    which words q apart are identical and which no neighbouring word extends; its last
    period may be cut short. Runs may overlap.

    Returns for every row of ``docs``: row (the whole row as a struct, so other columns
    may have any names), n_words, runs (start, length and period, by start, then period)
    and collapsed (the words, joined by a blank, but those that any run contains after its
    first period). A null, empty or blank text has no words and no runs, and "" is left of
    it. Repeated rows and null ids are judged like others; each text by itself, so
    nothing is shuffled. A text of n words takes about n log n comparisons in numpy, so a
    very long one is judged whole by one task, in memory of some ten times its size.
    """
    if min_repeats < 2 or min_words < 2:
        raise ValueError("min_repeats and min_words: 2 or more are asked for")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, (F.col(text) if isinstance(text, str) else text).cast("binary").alias("text"))
    schema = rows.schema[:1].add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "binary")
    found = rows.mapInArrow(_judged(min_words, min_repeats), schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))
