"""Quality rules: base measures and a short-circuit cascade."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Rows, about, that the cascade's order is estimated on, and how often a rule judges each while
#: it is timed; the verdicts don't depend on them.
SAMPLE_ROWS, TIMED = 500, 3


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over text, words, n_words, word_chars, n_symbols, n_lines (lines with a
    word) and n_dup_lines; null counts as passed."""

    name: str
    fails: str


#: Few letters of scripts that put no blanks between words.
_SPACED = "regexp_count(text, '[\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}\\\\p{IsThai}\\\\p{IsLao}\\\\p{IsKhmer}\\\\p{IsMyanmar}]') < 0.3 * word_chars"
#: Judges what the base measures don't: share of symbols, repeated lines, odd word
#: lengths, letterless words. Ordinary prose in any script is far from each limit.
RULES = (
    Rule("symbols", "n_symbols > 0.3 * n_words"),
    Rule("repeated lines", "n_lines >= 4 AND n_lines - n_dup_lines < 0.4 * n_lines"),
    Rule("word length", f"CASE WHEN word_chars BETWEEN 2 * n_words AND 20 * n_words THEN false ELSE {_SPACED} END"),
    Rule("letters", "regexp_count(text, '\\\\p{L}') < 0.5 * word_chars"),
    Rule("longest word", f"CASE WHEN word_chars > 1000 THEN array_max(transform(words, w -> length(w))) > 1000 AND {_SPACED} END"),
)


def base_measures(text: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines (lines with a word) and n_dup_lines of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once, whatever the optimizer does with columns."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# Repeated three-word windows are found by sorting the (hash, position) pairs of a text's
# windows: equal neighbours are repeats. That takes n log n steps also for a million words.
_WINDOWS = "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))"
#: Starts of windows that occur twice or more, in order.
_REPEATED = """sort_array(filter(transform(w3, (x, k) -> CASE
    WHEN k > 0 AND w3[k - 1].h = x.h THEN x.i
    WHEN k < size(w3) - 1 AND w3[k + 1].h = x.h THEN x.i END), x -> x IS NOT NULL))"""
_COVERED = """CASE WHEN size(at) > 0 THEN 3L + aggregate(zip_with(slice(at, 2, size(at)), slice(at, 1, size(at) - 1),
    (b, a) -> least(b - a, 3)), 0L, (s, x) -> s + x) ELSE 0L END"""
_REPEAT_WORDS = _let("w", "words", f"CASE WHEN size(w) < 4 THEN 0L ELSE {_let('w3', _WINDOWS, _let('at', _REPEATED, _COVERED))} END")


def _measured(texts: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    """``texts`` (with the column text) with words, all measures and base_failed."""
    found = texts.withColumn("words", words(F.col("text")))
    found = found.withColumns(base_measures(F.col("text"), F.col("words"))).withColumn("n_repeat_words", F.expr(_REPEAT_WORDS))
    failed = f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"
    return found.withColumn("base_failed", F.expr(failed))


def cascade_order(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, min_words: int = 50, max_repeat_percent: int = 50
) -> tuple[Rule, ...]:
    """Order rules by rejections per cost, on about ``sample_rows`` rows from all over ``docs``.

    The order decides only how early a document's cascade ends, never its verdict.
    ``docs`` has the column text. Rows are drawn where they are read, so only the
    sample is shuffled, into the one task that each rule is timed in; rows that fail
    the base measures never reach the cascade and are left out. A rule's cost is what it
    takes beyond a rule that does nothing. The next rule is the one that rejects
    most, for its cost, of the rows that the rules before it have let pass.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = _measured(docs.select("text").sample(share, seed=0).repartition(1), min_words, max_repeat_percent)
    sample = drawn.filter("NOT base_failed").persist()
    try:
        names = [f"r{k}" for k in range(len(rules))]
        flags = [F.coalesce(F.expr(rule.fails), F.lit(False)).alias(n) for n, rule in zip(names, rules, strict=True)]
        rejected = [{k for k, row in enumerate(rows) if row[n]} for rows in [sample.select(*flags).collect()] for n in names]
        often = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMED))))

        def seconds(fails: str) -> float:
            began = time.perf_counter()
            often.agg(F.count_if(F.expr(f"({fails}) AND again > 0"))).collect()
            return time.perf_counter() - began

        base = min(seconds("size(words) < 0") for _ in range(2))
        costs = [max(1e-3, seconds(rule.fails) - base) for rule in rules]
    finally:
        sample.unpersist()
    order, gone, left = [], set(), list(range(len(rules)))
    while left:
        best = max(left, key=lambda k: ((len(rejected[k] - gone) + 0.5) / costs[k], -k))
        left.remove(best)
        gone |= rejected[best]
        order.append(rules[best])
    return tuple(order)


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Measure and judge every document.

    Returns one row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept. ``base_failed`` holds with
    fewer than ``min_words`` words, or if more than ``max_repeat_percent`` percent
    of the words are in three-word windows that the text has twice or more. A
    document is kept if it is not base_failed and fails none of ``rules``, which
    run as a cascade: each is computed only for documents that passed those
    before it, in the order of ``cascade_order``. A null or empty text has no words
    and fails. A very long text is measured by one task. Null ids and repeated rows are judged like others; other columns are
    not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("i"), text.alias("text"))
    order = cascade_order(texts, rules, min_words=min_words, max_repeat_percent=max_repeat_percent)
    cascade = " ".join(f"WHEN {rule.fails} THEN false" for rule in order)
    measured = _measured(texts, min_words, max_repeat_percent)
    return measured.select(
        F.col("i").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.expr(f"CASE WHEN base_failed THEN false {cascade} ELSE true END").alias("kept"),
    )


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The verdict is computed beside the row, so neither a join nor unique ids are
    needed. Columns may have any names: the row travels as one nested value.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("i"), F.col(text_col).alias("text"))
    # beside an indeterminate column the verdict is a column too: a filter that moved below
    # would split the text again for each use of its words
    judged = quality_rules(row, id_col="i", text_col="text", **options).withColumn("n", F.monotonically_increasing_id())
    return judged.filter("kept AND n >= 0").select("i.*")
