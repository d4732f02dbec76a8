"""Substrings, trimming, tabs, splitting and wrapping of text with control sequences.

Cuts, splits and overlays leave texts that need it to ``machine``: positions are looked up
in the prefix sums of the widths, and the format at the cut is put back in front and ended
behind. The rest is made of expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .controls import Ctl, control_pattern, kinds, strip_ctl
from .machine import ENDS, WHITE, Options, Positions, carried_in, ctl_names, in_batches, machine, split_pattern, state_of
from .state import TermCap, fold, let
from .width import is_plain, width_of
from .wrap import BREAK, GAP, WIDE_GAP, Wrapping, paragraphs, wrapped

IntColumn = Column | int
ROUND = ("start", "stop", "both", "neither")


def _int(value: IntColumn) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def substr_ctl(
    x: Column,
    start: IntColumn,
    stop: IntColumn,
    type: str = "chars",
    round: str = "start",
    ctl: Ctl = "all",
    normalize: bool = False,
    terminate: bool = True,
    carry: Column | str | None = None,
    tab_stops: tuple[int, ...] | None = None,
    term_cap: TermCap = None,
) -> Column:
    """The part of ``x`` from position ``start`` to ``stop``, in the format that it has there.

    ``carry`` is the state that the text begins in, or a text that ends in it. With ``tab_stops``
    tabs become spaces first. A stop before the start, or below 1, gives "".

    Texts without controls (and, by width, without wide characters) stay within Catalyst; others
    go through Arrow batches, so this can't be used within functions of arrays.
    """
    if round not in ROUND:
        raise ValueError(f"round: {round!r} is none of {', '.join(ROUND)}")
    carried = carried_in(carry)
    start, stop = _int(start), _int(stop)
    control = control_pattern(ctl)
    inside = (stop >= start) & (stop >= 1)
    if carry is not None:
        simple = F.lit(False)
    elif type == "chars":
        simple = ~x.rlike(control) if control else F.lit(True)
    else:
        simple = is_plain(x)  # which leaves no control
    if tab_stops:
        simple = simple & ~x.contains("\t")
    options = Options(type, round, ctl_names(ctl), normalize, terminate, tab_stops)

    def cut(p: Positions, a: int, b: int, registers: list | None = None) -> str:
        return machine(term_cap).cut(p, a, b, state_of(registers))

    plain = F.substring(x, F.greatest(start, F.lit(1)), stop - F.greatest(start, F.lit(1)) + 1)
    general = in_batches("string", cut, F.when(inside & ~simple, x), start, stop, *carried, prepared=(options,))
    return F.when(x.isNotNull() & start.isNotNull() & stop.isNotNull(), F.when(~inside, "").when(simple, plain).otherwise(general))


def overlay_ctl(
    x: Column,
    value: Column,
    start: IntColumn,
    stop: IntColumn,
    type: str = "chars",
    round: str = "start",
    ctl: Ctl = "all",
    normalize: bool = False,
    terminate: bool = True,
    carry: Column | str | None = None,
    value_carry: Column | str | None = None,
    tab_stops: tuple[int, ...] | None = None,
    term_cap: TermCap = None,
) -> Column:
    """``x`` with positions start to stop taken by ``value``, cut to the room that there is.

    A shorter value takes as many positions as it has, and so does one that loses a wide
    character to the cut; the text behind follows it. What stands before and behind stays as it is,
    each in its own format; ``normalize`` is for the value and what is written around it. Without
    ``terminate`` formats run on, and the text behind gets what leads from the format of the text
    before to its own. ``carry`` and ``value_carry`` are the states that the two texts begin in.
    Null if any argument is. Texts and values without controls and wide characters stay within Catalyst.
    """
    if round not in ROUND:
        raise ValueError(f"round: {round!r} is none of {', '.join(ROUND)}")
    start, stop = _int(start), _int(stop)
    options = Options(type, round, ctl_names(ctl), normalize, terminate, tab_stops)

    def simple(t: Column) -> Column:
        control = control_pattern(ctl)
        clean = ~t.rlike(control) if control else F.lit(True)
        clean = clean & ~t.contains("\t") if tab_stops else clean
        return clean if type == "chars" else clean & is_plain(t)

    def put(p: Positions, v: Positions, a: int, b: int, *registers: list | None) -> str:
        return machine(term_cap).overlay(p, v, a, b, *map(state_of, registers))

    plainly = simple(x) & simple(value) & F.lit(carry is None and value_carry is None)
    begin = F.greatest(start, F.lit(1))
    have, room = F.char_length(x), F.least(stop, F.char_length(x)) - begin + 1
    taken = F.least(room, F.char_length(value))
    lead = F.substring(x, F.lit(1), begin - 1)
    native = F.when((room >= 1) & (stop >= start) & (taken >= 1), F.concat(lead, F.substring(value, F.lit(1), taken), F.substring(x, begin + taken, have))).otherwise(x)
    given = x.isNotNull() & value.isNotNull() & start.isNotNull() & stop.isNotNull()
    carried = [] if carry is None and value_carry is None else [*carried_in("" if carry is None else carry), *carried_in("" if value_carry is None else value_carry)]
    general = in_batches("string", put, F.when(given & ~plainly, x), F.when(given, value), start, stop, *carried, prepared=(options, options))
    return F.when(given, F.when(plainly, native).otherwise(general))


def strtrim_ctl(
    x: Column, width: IntColumn, ctl: Ctl = "all", normalize: bool = False, terminate: bool = True,
    carry: Column | str | None = None, tab_stops: tuple[int, ...] | None = None, term_cap: TermCap = None,
) -> Column:
    """The first ``width`` columns of ``x``."""
    return substr_ctl(x, 1, width, "width", "neither", ctl, normalize, terminate, carry, tab_stops, term_cap)


def trimws_ctl(x: Column, which: str = "both", normalize: bool = False, ctl: Ctl = "all", term_cap: TermCap = None) -> Column:
    """``x`` without white space (blank, tab, \\r, \\n) at its ends, through the formats of ``ctl``, which stay.

    Blanks at the very ends go within Catalyst. Of texts with escapes the rest goes to Arrow batches, which give
    what is to be written at the ends; so this can't be used within functions of arrays.
    """
    if which not in ("both", "left", "right"):
        raise ValueError(f"which: {which!r} is none of both, left, right")
    formats = tuple(kind for kind in ("sgr", "url") if kind in kinds(ctl))
    trim = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[which]
    rest = trim(x)
    blanks = F.octet_length(x) - F.octet_length(F.rtrim(x)) if which != "left" else F.lit(0)

    def ends(t: bytes, n: int) -> tuple[str, int, int, str]:
        return machine(term_cap).trimmed(t, n, which, formats, normalize)

    found = in_batches(ENDS, ends, F.when(rest.contains("\x1b"), rest.cast("binary")), blanks)
    size = F.octet_length(rest) - found["skip"] - found["drop"]
    inside = F.substring(rest.cast("binary"), found["skip"] + 1, size).cast("string")
    return F.when(found.isNotNull(), F.concat(found["opened"], inside, found["closing"])).otherwise(trim(rest, F.lit(WHITE)))


def tabs_as_spaces(x: Column, tab_stops: tuple[int, ...] = (8,), ctl: Ctl = "all") -> Column:
    """Tabs as spaces up to the next stop; the last stop's distance repeats. Line breaks start over."""
    stops = list(tab_stops)
    if not stops or min(stops) < 1:
        raise ValueError("tab_stops: positive integers are asked for")
    fixed = [sum(stops[: k + 1]) for k in range(len(stops))]

    def pad(at: Column) -> Column:
        beyond = F.lit(fixed[-1]) + F.lit(stops[-1]) * (F.floor((at - fixed[-1]) / stops[-1]) + 1)
        next_stop = beyond
        for f in reversed(fixed):
            next_stop = F.when(at < f, F.lit(f)).otherwise(next_stop)
        return F.repeat(F.lit(" "), (next_stop - at).cast("int"))

    def behind(piece: Column, at: Column) -> Column:
        """The column after ``piece``, which begins in column ``at``."""
        last = F.regexp_extract(piece, r"([^\n]*+)\z", 1)
        return (F.when(piece.contains("\n"), 0).otherwise(at) + width_of(strip_ctl(last, tuple(kinds(ctl))))).cast("int")

    def step(at: Column, piece: Column) -> Column:
        return let(pad(at), lambda p: F.struct(behind(piece, at + F.char_length(p)).alias("state"), F.concat(p, piece).alias("out")))

    def expanded(parts: Column) -> Column:
        first = F.element_at(parts, 1)
        rest = fold(F.slice(parts, 2, F.size(parts)), behind(first, F.lit(0)), step)
        return F.concat(first, F.array_join(rest["out"], ""))

    return F.when(x.contains("\t"), let(F.split(x, "\t", -1), expanded)).otherwise(x)


def strsplit_ctl(
    x: Column, split: str | Column, fixed: bool = False, ctl: Ctl = "all", normalize: bool = False, terminate: bool = True,
    carry: Column | str | None = None, term_cap: TermCap = None,
) -> Column:
    """Pieces of ``x`` between matches of ``split`` (a regular expression of the library regex) in its visible text.

    An empty ``split`` gives the characters. A text that ends in a match has no empty last
    piece, an empty text has no pieces, and one without a match is one piece: as it is, or in its
    format like any other piece if it begins in one by ``carry``, the state that the text begins in
    (which the reference documents, but leaves out for such texts). ``split`` may be a column. Texts
    without controls that are split by a fixed text stay within Catalyst; others go through Arrow batches.
    """
    options, control = Options("chars", "start", ctl_names(ctl), normalize, terminate), control_pattern(ctl)

    def cut(p: Positions, by: str, registers: list | None = None) -> list[str] | None:
        return None if by is None else machine(term_cap).split(p, split_pattern(by, fixed), state_of(registers))

    by = F.lit(split) if isinstance(split, str) else split
    carried = carried_in(carry)
    if not isinstance(split, str) or not split or not (fixed or re.escape(split).replace("\\ ", " ") == split) or carry is not None:
        return F.when(by.isNotNull(), in_batches("array<string>", cut, x, by, *carried, prepared=(options,)))
    parts = F.split(x, re.escape(split), -1)
    clean = ~x.rlike(control) if control else F.lit(True)
    whole = let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return F.when(clean, whole).otherwise(in_batches("array<string>", cut, F.when(~clean, x), by, prepared=(options,)))


def _paragraphs(x: Column) -> Column:
    """The paragraphs of a text without escapes, with white space as one blank, or two after the end of a sentence."""

    def squeezed(p: Column) -> Column:
        words = F.regexp_replace(F.translate(p, "\t\n", "  "), F.lit(GAP), F.lit(" "))
        return F.btrim(F.regexp_replace(words, F.lit(WIDE_GAP), F.lit("  ")), F.lit(" "))

    parts = F.transform(F.split(x, BREAK, -1), squeezed)
    return let(F.filter(parts, lambda p: p != ""), lambda found: F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found))


def squeeze_space(x: Column) -> Column:
    """White space as one blank; two after the end of a sentence; an empty line between paragraphs.

    Controls within white space go behind it. Texts with escapes go through Arrow batches.
    """
    escapes = x.contains("\x1b")
    apart = in_batches("string", lambda t: "\n\n".join(paragraphs(t)), F.when(escapes, x))
    return F.when(escapes, apart).when(x.isNotNull(), F.array_join(_paragraphs(x), "\n\n"))


#: Columns up to which lines are found by a regular expression, which goes as deep as a line is wide.
_PATTERN_WIDTH = 1000


def _line_pattern(head: int, rest: int) -> str:
    """A regular expression for the lines of a paragraph in turn: as many words as fit, or one that is too long.

    Each character is a column.
    """

    def line(width: int) -> str:
        more = f"(?:.{{0,{width - 2}}}[^ ])?" if width > 1 else ""
        fits = rf"[^ ]{more}(?= |\z)|" if width > 0 else ""
        return f"(?:{fits}[^ ]++)"

    return line(rest) if head == rest else rf"(?:\A{line(head)}|(?<!\A){line(rest)})"


def strwrap_ctl(
    x: Column,
    width: int = 72,
    indent: int = 0,
    exdent: int = 0,
    prefix: str = "",
    initial: str | None = None,
    wrap_always: bool = False,
    pad_end: str = "",
    strip_spaces: bool = True,
    tab_stops: tuple[int, ...] | None = None,
    ctl: Ctl = "all",
    normalize: bool = False,
    terminate: bool = True,
    carry: Column | str | None = None,
    term_cap: TermCap = None,
) -> Column:
    """Lines of at most ``width`` - 1 columns, as an array; null is the text "NA".

    White space is squeezed first; each line begins with the format in force there, in front of
    its prefix, and what fills it up is in the format at its end. An empty line has a prefix but no indent.
    ``wrap_always`` breaks words that are longer than a line; ``pad_end`` is a character
    to fill lines up with. Without ``strip_spaces`` white space stays as it is and each line
    break begins a paragraph; with ``tab_stops`` tabs become spaces first. A text of nothing but
    controls is one line.

    Texts of plain characters are filled within Catalyst; those with controls or wide characters, and
    all with options that keep white space, break words, make tabs spaces or carry a state, go through Arrow batches.
    """
    target = max(1, width - 1)
    head, rest = (prefix if initial is None else initial) + " " * indent, prefix + " " * exdent
    names = () if not control_pattern(ctl) else ctl_names(ctl)
    how = Wrapping(target, head, rest, indent, exdent, wrap_always, pad_end, strip_spaces, tab_stops, names, normalize, terminate)
    x = F.coalesce(x, F.lit("NA"))

    def general(t: Column) -> Column:
        return in_batches("array<string>", lambda t, s=None: wrapped(machine(term_cap), t, how, state_of(s)), t, *carried_in(carry))

    if wrap_always or not strip_spaces or tab_stops or carry is not None or target > _PATTERN_WIDTH:
        return general(x)
    plain = is_plain(F.translate(x, "\t\n", "  "))
    pattern = F.lit(_line_pattern(target - len(head), target - len(rest)))

    empty = head[: len(head) - indent] + pad_end * max(0, target - len(head))

    def led(line: Column, k: Column) -> Column:
        text = F.concat(F.when(k == 0, head).otherwise(rest), line)
        return F.rpad(text, F.greatest(F.char_length(text), F.lit(target)), F.lit(pad_end)) if pad_end else text

    def lines(paragraph: Column) -> Column:
        return F.when(paragraph == "", F.array(F.lit(empty))).otherwise(F.transform(F.regexp_extract_all(paragraph, pattern, F.lit(0)), led))

    quick = F.flatten(F.transform(_paragraphs(x), lines))
    return F.when(plain, quick).otherwise(general(F.when(~plain, x)))
