"""Display width of text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the widths: Python's own tables, with what later versions changed.
UNICODE_VERSION = "17.0.0"

# Ranges that are wide, without width, and a column wide since Unicode 15.1.
LATER_WIDE = (
    (0x2630, 0x2637), (0x268A, 0x268F), (0x31E4, 0x31E5), (0x4DC0, 0x4DFF), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CFF, 0x18CFF), (0x18D09, 0x18D1E),
    (0x18D80, 0x18DF2), (0x1D300, 0x1D356), (0x1D360, 0x1D376), (0x1F6D8, 0x1F6D8), (0x1FA89, 0x1FA8A), (0x1FA8E, 0x1FA8F), (0x1FABE, 0x1FABE), (0x1FAC6, 0x1FAC6),
    (0x1FAC8, 0x1FAC8), (0x1FACD, 0x1FACD), (0x1FADC, 0x1FADC), (0x1FADF, 0x1FADF), (0x1FAE9, 0x1FAEA), (0x1FAEF, 0x1FAEF),
)
LATER_ZERO = (
    (0x0897, 0x0897), (0x1ACF, 0x1ADD), (0x1AE0, 0x1AEB), (0x10D69, 0x10D6D), (0x10EFA, 0x10EFC), (0x113BB, 0x113C0), (0x113CE, 0x113CE), (0x113D0, 0x113D0),
    (0x113D2, 0x113D2), (0x113E1, 0x113E2), (0x11B60, 0x11B60), (0x11B62, 0x11B64), (0x11B66, 0x11B66), (0x11F5A, 0x11F5A), (0x1611E, 0x16129), (0x1612D, 0x1612F),
    (0x1E5EE, 0x1E5EF), (0x1E6E3, 0x1E6E3), (0x1E6E6, 0x1E6E6), (0x1E6EE, 0x1E6EF), (0x1E6F5, 0x1E6F5),
)
LATER_ONE = ((0x1171E, 0x1171E),)

#: A pair of regional indicators is one flag; one alone is as wide.
_FLAGS = r"[\x{1F1E6}-\x{1F1FF}]{1,2}"
#: A joiner takes the character behind it along, unless that is ASCII or half a flag.
_JOINED = r"(?:\x{200D}++[^\x00-\x7F\x{1F1E6}-\x{1F1FF}]?+)"
_SKIN = r"[\x{1F3FB}-\x{1F3FF}]"
#: Text in which each character is a column: no table is needed.
_PLAIN = r"^[\x20-\x7E\xA1-\xAC\xAE-\x{2FF}]*+\z"


@lru_cache(maxsize=1)
def widths() -> np.ndarray:
    """0, 1 or 2 for every code point, in itself."""
    out = np.ones(0x110000, np.int8)
    for cp in (*range(0x40000), *range(0xE0000, 0xE1000)):  # elsewhere nothing is assigned but for private use
        if unicodedata.east_asian_width(chr(cp)) in "FW":
            out[cp] = 2
        if unicodedata.category(chr(cp)) in ("Mn", "Me", "Cf", "Cc") or 0x1160 <= cp <= 0x11FF:
            out[cp] = 0
    for ranges, width in ((LATER_WIDE, 2), (LATER_ZERO, 0), (LATER_ONE, 1), (((0xAD, 0xAD), (0xD800, 0xDFFF)), 1)):
        for a, b in ranges:
            out[a : b + 1] = width
    return out


#: Ranges of a class that are looked through once a character is known to be near them.
_NEAR = 16


def _class(inside: np.ndarray) -> str:
    """A character class of some code points, in two stages: a stretch that holds some of its ranges, then these."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]))).reshape(-1, 2)
    ranges = [(int(a), int(b) - 1) for a, b in edges]
    near = [ranges[k : k + _NEAR] for k in range(0, len(ranges), _NEAR)]
    span = lambda a, b: rf"\x{{{a:X}}}-\x{{{b:X}}}"
    return f"[{''.join(f'[{span(own[0][0], own[-1][1])}&&[{"".join(span(*r) for r in own)}]]' for own in near)}]"


@lru_cache(maxsize=1)
def classes() -> tuple[str, str]:
    """Character classes of zero-width and of double-width code points."""
    return _class(widths() == 0), _class(widths() == 2)


def _joined(x: Column) -> Column:
    """A flag as one wide character; what a joiner or skin tone adds to a picture dropped."""
    flags = F.regexp_replace(x, F.lit(_FLAGS), F.lit("\u4e00"))
    return F.regexp_replace(F.regexp_replace(flags, F.lit(_JOINED), F.lit("")), F.lit(_SKIN), F.lit(""))


def is_plain(x: Column) -> Column:
    """Whether each character of ``x`` is a column."""
    return x.rlike(_PLAIN)


def _counted(x: Column, of) -> Column:
    """``of`` text in which runs of ASCII letters are one letter, with the letters left out added."""
    short = F.regexp_replace(x, F.lit(r"[\x20-\x7E]{2,}+"), F.lit("x"))
    rest = F.element_at(F.transform(F.array(short), lambda s: of(_joined(s)) - F.char_length(s)), 1)
    return F.when(is_plain(x), F.char_length(x)).otherwise(F.char_length(x) + rest)


def width_of(x: Column) -> Column:
    """Columns that a terminal shows ``x`` in."""
    zero, wide = classes()
    return _counted(x, lambda y: F.char_length(y) + F.regexp_count(y, F.lit(wide)) - F.regexp_count(y, F.lit(zero)))


def graphemes_of(x: Column) -> Column:
    """Characters that a reader sees: those of any width, with what joins them as one."""
    zero, _ = classes()
    return _counted(x, lambda y: F.char_length(y) - F.regexp_count(y, F.lit(zero)))
