"""Control sequences: what they look like, and functions that find, drop or skip them.

All functions take and return columns and stay within Catalyst. ``ctl`` names the
kinds of sequences that count as controls: nl, c0, sgr, csi, esc, url, osc, or all;
"all" with other names means all but those.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .width import graphemes_of, width_of

# The names of the kinds of control sequences.
KINDS = ("nl", "c0", "sgr", "csi", "esc", "url", "osc")
Ctl = str | Iterable[str]

_OSC_BODY = r"[^\x07\x1B]*+(?:\x1B(?!\\)[^\x07\x1B]*+)*+(?:\x07|\x1B\\)?+"
#: One SGR sequence with its parameters, and one hyperlink with its parameters and address.
SGR = r"\x1B\[([^\x40-\x7E]*+)m"
URL = r"\x1B\]8;([^;\x07\x1B]*+);([^\x07\x1B]*+(?:\x1B(?!\\)[^\x07\x1B]*+)*+)(?:\x07|\x1B\\)?+"


def kinds(ctl: Ctl) -> frozenset[str]:
    names = {ctl} if isinstance(ctl, str) else set(ctl)
    if unknown := names - {*KINDS, "all"}:
        raise ValueError(f"ctl: unknown {sorted(unknown)}; known are {', '.join(KINDS)} and all")
    return frozenset(set(KINDS) - names if "all" in names else names)


def control_pattern(ctl: Ctl = "all") -> str:
    """A regular expression for one control sequence of the kinds; "" if there are none.

    Broken sequences are taken up to their end as a terminal would read them, or to
    the end of the string. An introducer whose kinds aren't asked for is an ordinary
    escape of two bytes, if those are.
    """
    want, found = kinds(ctl), []
    csi_end = {("csi", "sgr"): r"[\x40-\x7E]?+", ("sgr",): "m", ("csi",): r"(?:[\x40-\x6C\x6E-\x7E]|\z)"}
    asked = tuple(k for k in ("csi", "sgr") if k in want)
    if asked:
        found.append(rf"\[[^\x40-\x7E]*+{csi_end[asked]}")
    if "osc" in want:
        found.append(rf"\]{'' if 'url' in want else '(?!8;)'}{_OSC_BODY}")
    elif "url" in want:
        found.append(rf"\]8;{_OSC_BODY}")
    if "esc" in want:
        held = ("\\[" if asked else "") + ("\\]" if want & {"osc", "url"} else "")
        found.append(rf"(?:[^{held}]|\z)" if held else r"(?:.|\z)")
    # two ways to begin at most, so that other characters are passed by quickly
    ways = [rf"\x1B(?:{'|'.join(found)})"] if found else []
    single = (r"\x01-\x09\x0B-\x1A\x1C-\x1F\x7F" if "c0" in want else "") + (r"\n" if "nl" in want else "")
    if single:
        ways.append(f"[{single}]")
    return f"(?s:{'|'.join(ways)})" if ways else ""


def has_ctl(x: Column, ctl: Ctl = "all") -> Column:
    """Whether ``x`` has a control sequence; null for null, but false for all if ``ctl`` is empty."""
    pattern = control_pattern(ctl)
    return x.rlike(pattern) if pattern else F.lit(False)


def strip_ctl(x: Column, ctl: Ctl = "all") -> Column:
    """``x`` without its control sequences."""
    pattern = control_pattern(ctl)
    return F.regexp_replace(x, F.lit(pattern), F.lit("")) if pattern else x


def nchar_ctl(x: Column, type: str = "chars", ctl: Ctl = "all", keep_na: bool | None = None, allow_na: bool | None = None) -> Column:
    """Length of ``x`` without controls, in chars, bytes, width or graphemes.

    Null stays null for chars and bytes and counts 2 for width and graphemes;
    ``keep_na`` True or False makes it one or the other for all. A text that isn't valid
    UTF-8 gives null if ``allow_na`` is True, an error if it is False; None doesn't look.
    """
    rest = strip_ctl(x, ctl)
    measures = {"chars": F.char_length, "bytes": F.octet_length, "width": width_of, "graphemes": graphemes_of}
    if type not in measures:
        raise ValueError(f"type: {type!r} is none of {', '.join(measures)}")
    counted = measures[type](rest).cast("int")
    keep = type in ("chars", "bytes") if keep_na is None else keep_na
    found = counted if keep else F.coalesce(counted, F.lit(2))
    if allow_na is None or type == "bytes":
        return found
    invalid = F.lit(None).cast("int") if allow_na else F.raise_error("a text is not valid UTF-8").cast("int")
    return F.when(F.coalesce(F.is_valid_utf8(x), F.lit(True)), found).otherwise(invalid)


def nzchar_ctl(x: Column, ctl: Ctl = "all", keep_na: bool = False) -> Column:
    """Whether anything but controls is in ``x``; null is true, or null with ``keep_na``."""
    found = F.char_length(strip_ctl(x, ctl)) > 0
    return found if keep_na else F.coalesce(found, F.lit(True))


def strip_sgr(x: Column) -> Column:
    return strip_ctl(x, ("sgr", "url"))


def has_sgr(x: Column) -> Column:
    return has_ctl(x, ("sgr", "url"))


def nchar_sgr(x: Column, type: str = "chars", keep_na: bool | None = None) -> Column:
    return nchar_ctl(x, type, "sgr", keep_na)


def nzchar_sgr(x: Column, keep_na: bool = False) -> Column:
    return nzchar_ctl(x, "sgr", keep_na)
