"""Language-model scores by stupid backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .packed import Chunk, chunk_rows, pack_docs, ranges_for, sums_of, window_hashes, with_counts, word_hashes

#: Distinct n-grams of a chunk for each byte of its text, to size the hash ranges.
GRAMS_PER_BYTE = 0.33
ROW = "doc_id long, n_words long, log_sum double, n_unigram long"


def _grams(words: np.ndarray, doc: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order: hashes of the n-grams that start at each word, and which of them end in the document."""
    out = []
    for n in range(1, order + 1):
        inside = np.zeros(len(words), bool)
        inside[: len(words) - n + 1] = doc[n - 1 :] == doc[: len(words) - n + 1]
        out.append((window_hashes(words, n), inside))
    return out


def _features(order: int, ranges):
    def run(chunk: Chunk) -> np.ndarray:
        grams = _grams(*word_hashes(chunk.data, chunk.offsets), order)
        return ranges.cut(np.concatenate([h[inside] for h, inside in grams]))

    return run


def _score(order: int, backoff: float, min_count: int, ranges):
    def score(chunk: Chunk, sums: np.ndarray) -> pa.RecordBatch:
        words, doc = word_hashes(chunk.data, chunk.offsets)
        grams = _grams(words, doc, order)
        cut = [ranges.cut(h[inside]) for h, inside in grams]
        values, counts = np.unique(np.concatenate(cut)), []
        for (_, inside), hashes in zip(grams, cut, strict=True):
            full = np.zeros(len(words), np.int64)
            full[inside] = sums[np.searchsorted(values, hashes)] if len(hashes) else 0
            counts.append(full)
        n = len(words)
        logs, done, steps = np.zeros(n), np.zeros(n, bool), np.zeros(n)
        for k in range(order, 1, -1):
            # word i ends the k-gram that starts k - 1 before it, if that is in the same document
            has = np.zeros(n, bool)
            has[k - 1 :] = grams[k - 1][1][: max(0, n - k + 1)]
            whole, context = np.zeros(n, np.int64), np.ones(n, np.int64)
            whole[k - 1 :] = counts[k - 1][: max(0, n - k + 1)]
            context[k - 1 :] = counts[k - 2][: max(0, n - k + 1)]
            use = has & ~done & (whole >= min_count)
            logs[use] = np.log10(whole[use] / context[use]) + steps[use] * np.log10(backoff)
            done |= use
            steps += has & ~done
        rest = ~done
        logs[rest] = np.log10(np.maximum(counts[0][rest], 1)) + steps[rest] * np.log10(backoff)
        of = len(chunk)
        return pa.RecordBatch.from_arrays(
            [chunk.id_array(), pa.array(np.bincount(doc, minlength=of)), pa.array(np.bincount(doc, logs, minlength=of).astype(float)),
             pa.array(np.bincount(doc[rest], minlength=of))],
            ["doc_id", "n_words", "log_sum", "n_unigram"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in chunk_rows(batches):
            yield score(chunk, sums_of(row))

    return run


def lm_score(
    docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score every document by a model of the n-gram counts of all documents.

    Words are runs of anything but white space, with A-Z as a-z. A word's score is
    count(n-gram) / count(context) of the longest n-gram ending in it, within its
    document, of up to ``order`` words, that the corpus has ``min_count`` times or
    more, times ``backoff`` for each longer one that it lacks; in the end count(word) /
    count(all words).

    Returns one row per row of ``docs``: doc_id, n_words, log10_score (the sum over its
    words) and log10_per_word, both null for a null or blank text. Every row adds to
    the counts, so repeated rows count repeatedly. Null ids are scored like others;
    other columns are not read.

    The count tables are partitioned by hash. A chunk of documents asks each for its
    own n-grams once, however frequent they are, so hot n-grams don't gather.
    """
    chunks = pack_docs(docs, id_col, text_col)
    ranges = ranges_for(chunks, GRAMS_PER_BYTE)
    scored = with_counts(chunks, _features(order, ranges), ranges).mapInArrow(_score(order, backoff, min_count, ranges), ROW)
    scored = checkpointed(scored)
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    score = F.when(F.col("n_words") > 0, F.col("log_sum") - F.col("n_unigram") * F.log10(F.lit(float(max(1, total)))))
    return scored.select("doc_id", "n_words", score.alias("log10_score"), (score / F.nullif("n_words", F.lit(0))).alias("log10_per_word"))
