"""Operators from one row to several, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.controls import SGR, URL, control_pattern
from ..functions.html import html_code_block
from ..functions.machine import for_python, sizes
from .order import numbered


def _numbered(df: DataFrame, others: list[str], pieces: Column, into: str, number: str) -> DataFrame:
    """Rows by an outer explode: for the other, Spark works the array out a second time, to leave out rows without pieces."""
    found = df.select(*others, F.posexplode_outer(pieces).alias(number, into))
    return found.where(F.col(f"`{number}`").isNotNull()).withColumn(number, F.col(f"`{number}`") + 1)


def lines(df: DataFrame, text: str, into: str = "line", number: str = "line_no") -> DataFrame:
    """A row for each line of a text, numbered from 1; a null text has one null line."""
    others = [c for c in df.columns if c != text]
    split = F.coalesce(F.split(F.col(text), "\n", -1), F.array(F.lit(None).cast("string")))
    return _numbered(df, others, split, into, number)


def exploded(df: DataFrame, pieces: Column, into: str = "piece", number: str = "piece_no") -> DataFrame:
    """A row for each element of an array of pieces, numbered from 1."""
    return _numbered(df, df.columns, pieces, into, number)


# The SGR codes that are known, and those that ask for an ability.
_KNOWN = r"0|[1-9]|1[0-9]|2[0-9]|3[0-79]|4[0-79]|5[0-5]|6[0-5]|9[0-7]|10[0-7]|[34]8;5;\d+|[34]8;2;\d+;\d+;\d+"
_CAPABILITY = {"bright": r"9[0-7]|10[0-7]", "256": r"[34]8;5;\d+", "truecolor": r"[34]8;2;\d+;\d+;\d+"}
_CODES = re.compile(r"([34]8;0*5;\d+(?=;)|[34]8;0*2;\d+;\d+;\d+(?=;)|[^;]*+);")
_TOO_LARGE = re.compile(r"(?:^|;)(?:\d{4,}|[3-9]\d\d|2[6-9]\d|25[6-9])(?:;|$)")
_SGR, _URL = re.compile(f"(?s:{SGR})"), re.compile(f"(?s:{URL})")
_CONTROL = re.compile(for_python(control_pattern()))


@lru_cache(maxsize=1 << 15)
def problem(t: str, able: tuple[str, ...]) -> str | None:
    """What a terminal might not do with a control sequence; None if it is fine."""
    if t == "\n":
        return None
    ended = t.endswith(("\x07", "\x1b\\"))
    if m := _SGR.fullmatch(t):
        codes = [re.sub(r"(^|;)0+(?=[0-9])", r"\1", c or "0") for c in _CODES.findall(m[1] + ";")]
        if any(not re.fullmatch("[0-9;]*", c) or _TOO_LARGE.search(c) for c in codes):
            return "invalid-substr"
        if any(not re.fullmatch(_KNOWN, c) for c in codes):
            return "unknown-substr"
        return "exceed-term-cap" if any(re.fullmatch(p, c) for k, p in _CAPABILITY.items() if k not in able for c in codes) else None
    if t.startswith("\x1b["):
        if not re.fullmatch(r"(?s:\x1B\[.*[\x40-\x7E])", t):
            return "malformed-CSI/OSC"
        return "non-SGR/hyperlink" if re.fullmatch(r"\x1B\[[\x20-\x3F]*[\x40-\x7E]", t) else "CSI/OSC-bad-substr"
    if t.startswith("\x1b]") and not ended:
        return "malformed-CSI/OSC"
    if t.startswith("\x1b]8;"):
        if re.search(r"[^\x07\x1B\x20-\x7E\\]", t):
            return "CSI/OSC-bad-substr"
        m = _URL.fullmatch(t)
        return None if m and re.fullmatch("(?:id=[^:]*)?", m[1]) else "unknown-substr"
    if t.startswith("\x1b"):
        return "malformed-ESC" if t == "\x1b" else "non-SGR/hyperlink" if t.startswith("\x1b]") else "non-CSI/OSC"
    return "C0"


def problems(text: str | None, able: tuple[str, ...]) -> Iterator[dict]:
    """The sequences of a text that have a problem, in one pass over it."""
    found = list(_CONTROL.finditer(text or ""))
    if not found:
        return
    visible, before, controls = _CONTROL.sub("", text), 0, 0
    past = np.concatenate([[0], np.cumsum(sizes(visible, "width"))])
    for m in found:
        t = m.group()
        start = int(past[m.start() - before]) + controls
        before += len(t)
        controls += len(t.encode("utf-8", "surrogatepass"))
        if error := problem(t, able):
            yield {"start": start + 1, "stop": int(past[m.end() - before]) + controls, "error": error, "translated": False, "esc": t}


PROBLEM = "start int, stop int, error string, translated boolean, esc string"
_PROBLEM = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("error", pa.string()), ("translated", pa.bool_()), ("esc", pa.string())])


def unhandled_ctl(df: DataFrame, x: str, term_cap: tuple[str, ...] = ("bright", "256")) -> DataFrame:
    """A row for each control sequence that a terminal may not do as meant.

    Adds start and stop (from 1: visible text counts in columns, controls in bytes), error,
    translated (false: nothing is rewritten) and esc to the columns of ``df``. In SQL text it is the table
    function ``unhandled_ctl`` (``functions_for_sql``).
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(problems(t, term_cap)) for t in texts.to_pylist()], pa.list_(_PROBLEM))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    dirty = F.when(F.col(x).rlike(r"[\x01-\x09\x0B-\x1F\x7F]"), F.col(x))
    found = df.withColumn("_u", F.arrow_udf(run, f"array<struct<{PROBLEM.replace(' ', ':')}>>".replace(",:", ","))(dirty))
    return found.select(*df.columns, F.explode_outer("_u").alias("_u")).where(F.col("_u").isNotNull()).select(*df.columns, "_u.*")


class Unhandled:
    """The table function: a row for each problem of a text, for a terminal of the abilities of its second argument."""

    def eval(self, x: str, able: str = "bright,256") -> Iterator[tuple]:
        for row in problems(x, tuple(able.split(","))):
            yield tuple(row.values())


def code_blocks(df: DataFrame, x: str, by: list[str], order: str, css_class: str = "term") -> DataFrame:
    """The texts of each group, in order, as one block of HTML code: columns of ``by`` and html."""
    return df.groupBy(*by).agg(html_code_block(F.col(x), F.col(order), css_class).alias("html"))


def code_block_parts(df: DataFrame, x: str, by: list[str], order: list[str], css_class: str = "term", rows: int = 10_000) -> DataFrame:
    """Like ``code_blocks`` for groups of any size: columns of ``by``, part_no (from 1) and html; a block is its parts end to end.

    Texts are numbered in the order of group and ``order`` without one task (``order.numbered``); every
    ``rows`` numbers make a part, of each group that it reaches into. So no row and no task holds a whole group.
    """
    texts = numbered(df.select(*by, *[c for c in order if c not in by], F.col(x).alias("_x")), [*by, *order], "_n")
    texts = texts.withColumn("_part", F.floor((F.col("_n") - 1) / rows))
    pieces = texts.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct("_n", "_x"))).alias("_rows"))
    groups = texts.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last"))
    same = [pieces[c].eqNullSafe(groups[f"_g{k}"]) for k, c in enumerate(by)]
    text = F.array_join(F.transform("_rows", lambda r: r["_x"]), "\n", "NA")
    lead = F.when(F.col("_part") == F.col("_first"), f'<PRE class="{css_class}"><CODE>').otherwise("\n")
    tail = F.when(F.col("_part") == F.col("_last"), "</CODE></PRE>").otherwise("")
    return pieces.join(groups, same).select(*by, (F.col("_part") - F.col("_first") + 1).alias("part_no"), F.concat(lead, text, tail).alias("html"))
