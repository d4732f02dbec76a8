"""Formatted text in Arrow batches, for what expressions do too slowly.

The formats of a text are a machine's state; a run of sequences leads from one state to
another. Texts have few different states and runs, so where a run leads, and what has to be
written for it, is worked out once and remembered. Positions are looked up in the prefix sums
of a text's widths. Rows that need none of this don't come here: the functions of columns
(``text.py``, ``html.py``, ``normalize_state`` below) keep them within Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .controls import SGR, URL, Ctl, control_pattern, kinds
from .state import CODE_FAMILIES, END_LINK, NAMES, REGISTERS, TermCap, code_pattern, right_code, skipped_colours
from .width import widths

State = tuple[str, ...]
NONE: State = ("",) * len(NAMES)
#: States, runs and changes that a worker remembers.
REMEMBERED = 1 << 15

_LINK = len(REGISTERS)
_SLOTS = tuple(REGISTERS.values())
_CLOSERS = tuple(sorted({off for _, off in _SLOTS}))
_FAMILIES = {name: re.compile(pattern) for name, pattern in CODE_FAMILIES.items()}


def for_python(pattern: str) -> str:
    """A pattern of ``controls`` for Python, whose end of the text is another letter, without its groups."""
    return pattern.replace(r"\z", r"\Z").replace("([^", "(?:[^")


#: White space as it is trimmed.
WHITE = " \t\r\n"
_WHITE = WHITE.encode()
_BLANKS = re.compile(rb"[ \t\r\n]*+")
_ONE = re.compile(f"(?s:{SGR}|{URL})")
#: A run of formats and links (the group), or another sequence, whose inside isn't looked at.
TOKENS = re.compile(for_python(rf"(?s:(?P<run>(?:{SGR}|{URL})++)|{control_pattern(('all', 'sgr', 'url', 'nl', 'c0'))})"))
_SEQUENCE = re.compile(for_python(control_pattern(("all", "nl", "c0"))))
_LAST = re.compile(for_python(rf"(?s:(?:{SGR}|{URL})++\z)"))
_FIRST = re.compile(for_python(rf"(?s:(?:{SGR}|{URL})++)"))


def first_run(text: str) -> str:
    """The formats and links that ``text`` begins with."""
    found = _FIRST.match(text) if text.startswith("\x1b") else None
    return found.group() if found else ""


def without_last_run(text: str) -> str:
    """``text`` without the formats and links that it ends in."""
    return _LAST.sub("", text) if text.endswith(("m", "\\", "\x07")) or "\x1b]8;" in text else text


@lru_cache(maxsize=16)
def _controls(ctl: tuple[str, ...]) -> re.Pattern | None:
    pattern = control_pattern(ctl)
    return re.compile(for_python(pattern)) if pattern else None


def sizes(visible: str, type: str) -> np.ndarray:
    """The room that each code point takes.

    Of a pair of regional indicators the first is the whole flag. A joiner takes the character
    behind it along (unless that is ASCII), and a skin tone has no width of its own.
    """
    if type == "chars" or visible.isascii() and visible.isprintable():
        return np.ones(len(visible), np.int64)
    points = np.frombuffer(visible.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _width_table()[points].astype(np.int64)
    if points.max() >= 0x200D:
        flags = (points >= 0x1F1E6) & (points <= 0x1F1FF)
        joined = np.concatenate([[False], points[:-1] == 0x200D]) & (points >= 0x80)
        out[joined | (points >= 0x1F3FB) & (points <= 0x1F3FF)] = 0
        if flags.any():
            number = np.arange(len(points))
            begin = np.maximum.accumulate(np.where(flags, -1, number))  # the last place before the run of flags
            out[flags] = np.where((number - begin)[flags] % 2 == 1, 2, 0)
    return np.minimum(out, 1) if type == "graphemes" else out


@lru_cache(maxsize=1)
def _width_table() -> np.ndarray:
    return widths()


@dataclass
class Options:
    type: str = "chars"
    round: str = "start"
    ctl: tuple[str, ...] = ("all",)
    normalize: bool = False
    terminate: bool = True
    tab_stops: tuple[int, ...] | None = None


def expanded(text: str, stops: tuple[int, ...], ctl: tuple[str, ...]) -> str:
    """Tabs as blanks up to the next stop; the last stop's distance repeats, and lines begin anew."""
    control, fixed, out, at = _controls(ctl), np.cumsum(stops), [], 0
    for k, piece in enumerate(text.split("\t")):
        if k:
            n = int(np.searchsorted(fixed, at, "right"))
            blanks = int(fixed[n]) - at if n < len(fixed) else stops[-1] - (at - int(fixed[-1])) % stops[-1]
            out.append(" " * blanks)
            at += blanks
        out.append(piece)
        at = 0 if "\n" in piece else at
        last = piece.rsplit("\n", 1)[-1]
        at += int(sizes(control.sub("", last) if control else last, "width").sum())
    return "".join(out)


class Positions:
    """A text taken apart: visible characters, the controls between them, and prefix sums of the widths.

    ``all_of`` takes many texts apart and sums the widths of all in one go.
    """

    def __init__(self, text: str, options: Options, alone: bool = True) -> None:
        if options.tab_stops and "\t" in text:
            text = expanded(text, options.tab_stops, options.ctl)
        self.text, self.options, self.marks = text, options, []
        control, visible, at, n = _controls(options.ctl), [], 0, 0
        for m in control.finditer(text) if control else ():
            visible.append(text[at : m.start()])
            n += m.start() - at
            self.marks.append((n, m.group(), m.start(), m.end()))
            at = m.end()
        self.visible = "".join([*visible, text[at:]]) if self.marks else text
        if alone:
            self.past = np.cumsum(sizes(self.visible, options.type))

    @classmethod
    def all_of(cls, texts: list[str | None], options: Options) -> list[Positions | None]:
        found = [None if t is None else cls(t, options, False) for t in texts]
        given = [p for p in found if p is not None]
        # a line break keeps what joins characters within a text
        sums = np.concatenate([[0], np.cumsum(sizes("\n".join([p.visible for p in given]), options.type))])
        begin = 0
        for p in given:
            past = begin + len(p.visible)
            p.past = sums[begin + 1 : past + 1] - sums[begin]
            begin = past + 1
        return found

    @property
    def room(self) -> int:
        return int(self.past[-1]) if len(self.past) else 0

    def before(self, k: int) -> int:
        """The room of the first k characters."""
        return int(self.past[k - 1]) if k else 0

    def behind(self, room: int) -> int:
        """How many characters end within the first ``room`` positions, with those without width that follow."""
        return int(np.searchsorted(self.past, room, "right"))

    def first(self, start: int) -> int:
        """The character that position ``start`` begins with; one that lies across the cut counts if rounding says so."""
        at = self.behind(start - 1)
        across = at < len(self.past) and self.before(at) < start - 1
        return self.behind(int(self.past[at])) if across and self.options.round in ("stop", "neither") else at

    def last(self, stop: int, first: int) -> int:
        """Past the last character up to position ``stop``."""
        at = max(self.behind(stop), first)
        across = at < len(self.past) and self.before(at) < stop and self.options.round in ("stop", "both")
        return self.behind(int(self.past[at])) if across else at

    def offset(self, k: int, with_controls: bool) -> int:
        """Where in the text the k-th visible character stands: behind or in front of the controls before it."""
        out = k
        for n, _, begin, end in self.marks:
            if n > k or n == k and not with_controls:
                break
            out += end - begin
        return out


class Machine:
    """What runs of formats and links do, for a terminal of some abilities."""

    def __init__(self, term_cap: TermCap = None) -> None:
        self.skipped = skipped_colours(term_cap)
        self.code = re.compile(code_pattern(self.skipped))
        remember = lru_cache(maxsize=REMEMBERED)
        self.after, self.bridge = remember(self.after), remember(self.bridge)
        self.opened, self.closed = remember(self.opened), remember(self.closed)

    def codes(self, parameters: str) -> Iterable[str]:
        for found in self.code.findall(parameters + ";"):
            code = re.sub(r"(^|;)0+(?=[0-9])", r"\1", re.sub(r";(?=;|$)", ";0", found[:-1] or "0"))
            if right_code(code, self.skipped):
                yield code

    def after(self, state: State, run: str) -> State:
        """The state that ``run`` leads to. A link without an id is another each time, so it is marked if it comes again."""
        out = list(state)
        for m in _ONE.finditer(run):
            parameters, names, address = m.groups()
            if parameters is None:
                if not re.search(r"[^\x20-\x7E]", address):
                    name = re.search("(?:^|:)id=([^:]*)", names)
                    link = f"\x1b]8;{f'id={name[1]}' if name and name[1] else ''};{address}\x1b\\" if address else ""
                    out[_LINK] = link + "\0" if link and link == out[_LINK] and not (name and name[1]) else link
                continue
            for code in self.codes(parameters):
                family = next((name for name, pattern in _FAMILIES.items() if pattern.match(code)), code)
                for k, (on, off) in enumerate(_SLOTS):
                    out[k] = "" if code in ("0", off) else code if on == family else out[k]
        return tuple(out)

    def end(self, state: State, text: str) -> State:
        if "\x1b" in text:
            for m in TOKENS.finditer(text):
                if m["run"]:
                    state = self.after(state, m["run"])
        return state

    def opened(self, state: State, each: bool = False) -> str:
        return _sequences([c for c in state[:_LINK] if c], each) + state[_LINK].rstrip("\0")

    def closed(self, state: State, each: bool = False) -> str:
        on = {off for code, (_, off) in zip(state, _SLOTS, strict=False) if code}
        formats = _sequences([c for c in _CLOSERS if c in on], True) if each else "\x1b[0m" if on else ""
        return formats + (END_LINK if state[_LINK] else "")

    def bridge(self, a: State, b: State, each: bool) -> str:
        """The least sequences from one state to another; unless ``each``, anything that ends or changes means a reset."""
        link = "" if a[_LINK] == b[_LINK] else b[_LINK].rstrip("\0") or END_LINK
        pairs = list(zip(a[:_LINK], b[:_LINK], _SLOTS, strict=True))
        if each:
            ended = {off for was, now, (_, off) in pairs if was and not now}
            new = [now for was, now, (_, off) in pairs if now and (now != was or off in ended)]
            return _sequences([c for c in _CLOSERS if c in ended], True) + _sequences(new, True) + link
        new = [now for was, now, _ in pairs if now and now != was]
        if any(was and was != now for was, now, _ in pairs):
            new = ["0", *(now for was, now, _ in pairs if now and now == was), *new]
        return _sequences(new, False) + link

    def normalized(self, text: str, state: State = NONE) -> str:
        out, at = [], 0
        for m in TOKENS.finditer(text):
            if m["run"]:
                new = self.after(state, m["run"])
                out += text[at : m.start()], self.bridge(state, new, True)
                state, at = new, m.end()
        return "".join([*out, text[at:]])

    def formatted(self, state: State, body: str, options: Options) -> str:
        """``body`` with the format that it begins in put in front and, if it is to be terminated, ended behind."""
        if options.terminate:
            body = without_last_run(body)
            out = self.opened(state) + body + self.closed(self.end(state, body)) if body else ""
        else:
            out = self.opened(state) + body
        return self.normalized(out) if options.normalize else out

    def pieces(self, p: Positions, spans: Iterable[tuple[int, int, bool, bool]], state: State = NONE) -> Iterable[str]:
        """The characters [first, past) of each span, in the format that they have there; spans don't overlap.

        The last two of a span say whether controls at its very start are part of it, and whether the
        text ends before the stop that was asked for, when controls behind it are.
        """
        k, marks, single = 0, p.marks, _single(p.options.ctl)
        for first, past, from_start, to_end in spans:
            while k < len(marks) and (marks[k][0] < first or marks[k][0] == first and not from_start):
                state, k = self.end(state, marks[k][1]), k + 1
            body, at, j = [], first, k
            while j < len(marks) and (marks[j][0] < past or marks[j][0] == past and (to_end or marks[j][1] in single)):
                body += p.visible[at : marks[j][0]], marks[j][1]
                at, j = marks[j][0], j + 1
            yield self.formatted(state, "".join([*body, p.visible[at:past]]), p.options)

    def cut(self, p: Positions, start: int, stop: int, state: State = NONE) -> str:
        if stop < start or stop < 1:
            return ""
        first = p.first(start) if start >= 1 else 0
        return next(iter(self.pieces(p, [(first, p.last(stop, first), start < 1, p.room < stop)], state)))

    def split(self, p: Positions, pattern: re.Pattern | None, state: State = NONE) -> list[str]:
        """Pieces between matches in the visible text; a text without a match is one piece, as it is if it begins in no format."""
        n = len(p.visible)
        if not n:
            return []
        cuts = [(k, k) for k in range(1, n)] if pattern is None else [m.span() for m in pattern.finditer(p.visible) if m.start() < n]
        if not cuts and state == NONE:
            return [p.text]
        spans = zip([0, *(end for _, end in cuts)], [*(begin for begin, _ in cuts), n], strict=True)
        return list(self.pieces(p, [(a, max(a, b), False, False) for a, b in spans if a < n], state))

    def assigned(self, state: State, text: str) -> State:
        """Like ``end``, but a link without an address takes along what it runs into, as in ``state.events``."""
        for m in _SEQUENCE.finditer(text) if text else ():
            if _ONE.fullmatch(m.group()):
                state = self.after(state, m.group())
        return state

    def trimmed(self, text: bytes, blanks: int, which: str, formats: tuple[str, ...], each: bool = False) -> tuple[str, int, int, str]:
        """What to write in place of the white space and formats at a text's ends, and of how many bytes at each.

        ``blanks`` were behind the text, which a link that doesn't end takes along; they aren't counted.
        """
        whole, pattern, spans, at = text, _formats(formats), [], text.find(b"\x1b") if formats else -1
        while at >= 0:
            m = pattern.match(text, at)
            spans += [m.span()] if m else []
            at = text.find(b"\x1b", m.end() if m else at + 1)
        if blanks and spans and spans[-1][1] == len(text) and text.startswith(b"\x1b]", spans[-1][0]):
            whole = text + b" " * blanks
            spans[-1] = pattern.match(whole, spans[-1][0]).span()
        skip, end = 0, len(whole)
        if which != "right":
            for a, b in spans:
                if _BLANKS.match(whole, skip).end() < a:
                    break
                skip = b
            skip = _BLANKS.match(whole, skip).end()
        if which != "left":
            for a, b in reversed(spans):
                if _BLANKS.match(whole, b, end).end() < end:
                    break
                end = a
            end = max(skip, len(whole[:end].rstrip(_WHITE)) if end and whole[end - 1] in _WHITE else end)
        lead, inside, tail = (whole[i:j].decode("utf-8", "replace") if whole.find(b"\x1b", i, j) >= 0 else "" for i, j in ((0, skip), (skip, end), (end, len(whole))))
        begin, closing = self.assigned(NONE, lead), ""
        if tail:
            state = self.assigned(begin, inside)
            closing = self.bridge(_same_link(state), _same_link(self.assigned(state, tail)), each)
        return self.opened(begin, each), skip, max(0, len(text) - end), closing

    def overlay(self, p: Positions, v: Positions, start: int, stop: int, state: State = NONE, value_state: State = NONE) -> str:
        """The text with positions start to stop taken by the value, as much of it as there is room for.

        What stands before and behind is copied as it is, in the formats that it has there.
        """
        options, begin = p.options, max(start, 1)
        lead, tail = p.last(begin - 1, 0), p.first(stop + 1)
        taken = p.before(tail) - p.before(lead)
        v_first, given = v.first(1), min(stop, p.room) + 1 - begin

        def fitting(room: int) -> int:
            return v.last(room, v_first) if room >= 1 else v_first

        past = fitting(given)
        if v.before(past) > taken:  # rounded up by one: then one less, or nothing
            past = fitting(given - 1)
            past = past if v.before(past) <= taken else v_first
        held = v.before(past) - v.before(v_first)
        if held < taken:
            nearer = p.first(p.before(lead) + held + 1)
            tail = nearer if p.before(nearer) - p.before(lead) >= held else tail
        if stop < start or begin > p.room or (past <= v_first and options.terminate):
            return p.text
        rest = p.offset(tail, True)
        before = p.text[: p.offset(lead, not lead)] if start >= 1 and (lead or not options.terminate) else ""
        in_lead, in_tail = self.end(state, before), self.end(state, p.text[:rest])
        v_begin = self.end(value_state, v.text[: v.offset(v_first, True)])
        body = v.text[v.offset(v_first, True) : v.offset(past, False)]
        body = self.normalized(body, v_begin) if options.normalize else body
        out = [before, self.closed(in_lead, options.normalize) if before and options.terminate else ""]
        out += self.bridge(NONE, v_begin, options.normalize), body
        if options.terminate:
            out.append(self.closed(self.end(v_begin, body), options.normalize))
        if rest < len(p.text) and tail < len(p.visible):
            from_state = in_lead if before and not options.terminate else NONE
            out += self.bridge(from_state, in_tail, options.normalize), p.text[rest:]
        return "".join(out)


def _sequences(codes: list[str], each: bool) -> str:
    return "".join(f"\x1b[{c}m" for c in codes) if each else f"\x1b[{';'.join(codes)}m" if codes else ""


def _same_link(state: State) -> State:
    """The state with a link that came again as one that didn't."""
    return (*state[:_LINK], state[_LINK].rstrip("\0"))


@lru_cache(maxsize=4)
def _formats(formats: tuple[str, ...]) -> re.Pattern:
    """One format or link, of the kinds given, in bytes."""
    return re.compile(for_python(f"(?s:{'|'.join({'sgr': SGR, 'url': URL}[kind] for kind in formats)})").encode())


@lru_cache(maxsize=16)
def _single(ctl: tuple[str, ...]) -> frozenset[str]:
    """Controls of one byte, which stay with the character before them."""
    c0 = [chr(c) for c in (*range(1, 10), *range(11, 27), *range(28, 32), 127)] if "c0" in kinds(ctl) else []
    return frozenset([*c0, *(["\n"] if "nl" in kinds(ctl) else [])])


@lru_cache(maxsize=64)
def split_pattern(split: str, fixed: bool):
    """None for single characters."""
    import regex

    return regex.compile(regex.escape(split) if fixed else split) if split else None


@lru_cache(maxsize=8)
def machine(term_cap: TermCap) -> Machine:
    """A worker keeps its machines, with what they remember, for the batches and tasks that follow."""
    return Machine(term_cap)


def state_of(registers: list[str | None] | None) -> State:
    """A state as columns have it (``state.events``) as the machine's."""
    return NONE if registers is None else tuple(v or "" for v in registers)


def carried_in(carry: Column | str | None) -> list[Column]:
    """The state that texts begin in as columns for ``in_batches``: a column, or a text at whose end it is."""
    if isinstance(carry, str):
        return [F.array(*[F.lit(v) for v in Machine().end(NONE, carry)])]
    return [] if carry is None else [F.when(carry.isNotNull(), carry)]


def ctl_names(ctl: Ctl) -> tuple[str, ...]:
    kinds(ctl)
    return (ctl,) if isinstance(ctl, str) else tuple(ctl)


#: What ``Machine.trimmed`` gives.
ENDS = "struct<opened:string,skip:int,drop:int,closing:string>"
_ENDS = pa.struct([("opened", pa.string()), ("skip", pa.int32()), ("drop", pa.int32()), ("closing", pa.string())])


def in_batches(kind: str, of_row: Callable, *columns: Column, prepared: tuple[Options, ...] = ()) -> Column:
    """A column of ``kind`` by a function of each row's values, over Arrow batches; null where the first value is.

    The first columns are given as ``Positions`` if there are options for them.

    Spark doesn't give Python the results of functions within functions of arrays directly. Put into a column
    of their own first, with ``withColumn``, they can be used. The same is asked for results of ``trimws_ctl``.
    """
    if any(len(re.findall(r"\b(?:transform|filter|exists|aggregate|zip_with)\(", t)) > 1 or "['closing']" in t for t in map(str, columns)):
        raise ValueError("an argument is made of functions of arrays, or by trimws_ctl; put it into a column first, with withColumn")
    as_arrow = {"string": pa.string(), "array<string>": pa.list_(pa.string()), ENDS: _ENDS}[kind]

    def run(x: pa.Array, *others: pa.Array) -> pa.Array:
        values = [column.to_pylist() for column in (x, *others)]
        for k, options in enumerate(prepared):
            values[k] = Positions.all_of(values[k], options)
        rows = zip(*values, strict=True)
        return pa.array([None if row[0] is None else of_row(*row) for row in rows], as_arrow)

    return F.arrow_udf(run, kind)(*columns)


def normalize_state(x: Column, carry: Column | str | None = None, term_cap: TermCap = None) -> Column:
    """``x`` with each run of SGR and hyperlinks as the least changes, a sequence for each code.

    Codes that change nothing go; a link without an id that comes again is another. With ``carry`` (a
    state, or a text that ends in it) the text is taken to begin in that state. Texts without escapes don't leave Catalyst.
    """
    dirty = F.when(x.contains("\x1b"), x)
    return F.coalesce(in_batches("string", lambda t, s=None: machine(term_cap).normalized(t, state_of(s)), dirty, *carried_in(carry)), x)
