"""Lines of wrapped text, in Arrow batches, for texts that one regular expression can't fill.

Words are looked up in the prefix sums of a paragraph's widths, one search for each line. A
line's format is found from the line before it by the format machine, so a text costs what
its lines and sequences do. ``text.strwrap_ctl`` sends only texts here that need it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .controls import control_pattern
from .machine import NONE, Machine, Options, Positions, State, expanded, first_run, for_python, without_last_run

#: Between paragraphs; blanks that are one word's gap; blanks of which two stay.
BREAK = r"(?<![ \t])[ \t]*+\n(?:[ \t]*+\n)++[ \t]*+"
GAP = r"(?<! )(?<![.?!])(?<![.?!][\"')]) {2,}"
WIDE_GAP = " {3,}"


@lru_cache(maxsize=1)
def _space() -> tuple[re.Pattern, ...]:
    control = control_pattern(("all", "nl"))
    # white space with controls in it, looked for once in white space and not at each blank
    broken = rf"(?<![ \t\n])[ \t\n]++(?:(?:{control})++[ \t\n]++)++"
    # blanks and controls beyond a paragraph's first and its last word
    first, last = rf"^ *+((?:{control})++) ++", rf"(?<! ) ++((?:{control})++) *+\z"
    return tuple(re.compile(for_python(p)) for p in (control, broken, first, last, BREAK, GAP, WIDE_GAP))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of ``text``: white space as one blank, or two after the end of a sentence; controls within it go behind it."""
    control, broken, first, last, between, gap, wide = _space()
    escapes = "\x1b" in text
    if escapes:
        text = broken.sub(lambda m: control.sub("", m.group()) + "".join(c.group() for c in control.finditer(m.group())), text)
    out = []
    for part in between.split(text) if "\n" in text else [text]:
        part = part.replace("\t", " ").replace("\n", " ")
        if escapes and "\x1b" in part:
            part = last.sub(r"\1", first.sub(r"\1", part))
        out.append((wide.sub("  ", gap.sub(" ", part)) if "  " in part else part).strip(" "))
    return [p for p in out if p] or [""]


@dataclass(frozen=True)
class Wrapping:
    """The options of ``text.strwrap_ctl``; ``target`` is a line's greatest width.

    ``head`` and ``rest`` begin lines; they end in ``indent`` and ``exdent`` blanks.
    """

    target: int
    head: str
    rest: str
    indent: int = 0
    exdent: int = 0
    wrap_always: bool = False
    pad_end: str = ""
    strip_spaces: bool = True
    tab_stops: tuple[int, ...] | None = None
    ctl: tuple[str, ...] = ("all",)
    normalize: bool = False
    terminate: bool = True

    @property
    def measure(self) -> Options:
        return Options("width", ctl=self.ctl)

    def size(self, text: str) -> int:
        return len(text) if text.isascii() and text.isprintable() else Positions(text, self.measure).room


def filled(paragraph: str, how: Wrapping) -> Iterator[str]:
    """As many words as fit in each line, or one that is too long; blanks between lines go."""
    p = Positions(paragraph, how.measure)
    points = np.frombuffer(p.visible.encode("ascii"), np.uint8) if p.visible.isascii() else np.frombuffer(p.visible.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.concatenate([[False], points != 32, [False]])
    at, to = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    if not len(at):
        yield paragraph
        return
    room = np.concatenate([[0], p.past])
    begins, past = room[at].tolist(), room[to].tolist()
    if p.marks:  # the controls before a word and behind one go with it
        where = np.array([m[0] for m in p.marks])
        taken = np.concatenate([[0], np.cumsum([m[3] - m[2] for m in p.marks])])
        at, to = at + taken[where.searchsorted(at, "left")], to + taken[where.searchsorted(to, "right")]
    at, to, k, width = at.tolist(), to.tolist(), 0, how.target - len(how.head)
    while k < len(at):
        behind = max(k + 1, bisect_right(past, begins[k] + width, k))
        yield paragraph[at[k] : to[behind - 1]]
        k, width = behind, how.target - len(how.rest)


def parts(word: str, limit: int, how: Wrapping) -> Iterator[str]:
    """A word as parts of at most ``limit`` columns, or of one character; characters without width stay with the one before."""
    p = Positions(word, how.measure)
    if p.room <= limit:
        yield word
        return
    begin, used, wide = 0, 0, np.diff(p.past, prepend=0)
    for k in np.flatnonzero(wide).tolist():
        if used and used + wide[k] > limit:
            at = p.offset(k, True)  # controls at the cut stay in front of it
            yield word[begin:at]
            begin, used = at, 0
        used += int(wide[k])
    yield word[begin:]


def word_by_word(paragraph: str, how: Wrapping) -> Iterator[str]:
    """Lines that keep their white space, or that break words: a word goes on in the next line without a blank."""
    words: Iterable[tuple[str, bool]] = ((w, False) for w in paragraph.split(" "))
    if how.wrap_always:
        limit = how.target - max(len(how.head), len(how.rest))
        words = ((part, k > 0) for w, _ in words for k, part in enumerate(parts(w, limit, how)))
    line, used, n, room = [], 0, 0, how.target - len(how.head)
    finish = (lambda t: t.rstrip(" ")) if how.strip_spaces else (lambda t: t)
    for word, on in words:
        gap, width = "" if not n or on else " ", how.size(word)
        if not n or used + len(gap) + width <= room:
            line += gap, word
            used, n = used + len(gap) + width, n + 1
        else:
            yield finish("".join(line))
            # an empty word is a blank, which a line doesn't begin with
            line, used, n, room = [word], width, int(word != ""), how.target - len(how.rest)
    yield "".join(line)


def wrapped(known: Machine, text: str | None, how: Wrapping, state: State = NONE) -> list[str]:
    """The lines of ``text``, prefix and padding included, each in the format that is in force where it begins."""
    text = "NA" if text is None else text
    if how.tab_stops and "\t" in text:
        text = expanded(text, how.tab_stops, how.ctl)
    fill = word_by_word if how.wrap_always or not how.strip_spaces else filled
    out = []
    for paragraph in paragraphs(text) if how.strip_spaces else text.split("\n"):
        lead, indent = how.head, how.indent
        for line in fill(paragraph, how):
            pad = how.pad_end * max(0, how.target - len(lead) - how.size(line)) if how.pad_end else ""
            body, run, opened, closed = line, "", "", ""
            if how.ctl and ("\x1b" in line or state != NONE):
                body = without_last_run(line) if how.terminate else line
                if body or pad or not how.terminate:  # an empty line opens nothing that it would close at once
                    run = first_run(body)
                    opened = known.opened(known.after(state, run) if run else state)
                    closed = known.closed(known.end(state, body)) if how.terminate else ""
                state = known.end(state, line)
            shown = "".join((opened, lead if body else lead[: len(lead) - indent], body[len(run) :], pad, closed))
            out.append(known.normalized(shown) if how.normalize else shown)
            lead, indent = how.rest, how.exdent
    return out
