"""Format state: registers that the last writer sets.

Every SGR code and hyperlink assigns registers without reading them, so the state
after a text is, register by register, the last assignment in it, or else the state
before. ``events`` gives a text's assignments as an array with an element for each
register: null for one that it leaves alone, "" for one that it clears, else the code
(for the hyperlink, the sequence) that sets it. States are such arrays too. Joining two
is a coalesce of their elements, and carrying over rows is a window's last non-null value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .controls import SGR, URL, control_pattern

# Registers in the order that their codes are written in, with the code that sets
# and the one that clears each (0 clears all). FG, BG and FONT stand for the codes of CODE_FAMILIES.
REGISTERS = {
    "bold": ("1", "22"),
    "faint": ("2", "22"),
    "italic": ("3", "23"),
    "underline": ("4", "24"),
    "blink": ("5", "25"),
    "fast_blink": ("6", "25"),
    "invert": ("7", "27"),
    "conceal": ("8", "28"),
    "crossout": ("9", "29"),
    "fraktur": ("20", "23"),
    "double_underline": ("21", "24"),
    "proportional": ("26", "50"),
    "fg": ("FG", "39"),
    "bg": ("BG", "49"),
    "framed": ("51", "54"),
    "encircled": ("52", "54"),
    "overlined": ("53", "55"),
    "ideogram60": ("60", "65"),
    "ideogram61": ("61", "65"),
    "ideogram62": ("62", "65"),
    "ideogram63": ("63", "65"),
    "ideogram64": ("64", "65"),
    "font": ("FONT", "10"),
}
CODE_FAMILIES = {"FG": "^(?:3[0-7]|9[0-7]|38;.*)$", "BG": "^(?:4[0-7]|10[0-7]|48;.*)$", "FONT": "^1[1-9]$"}
NAMES = (*REGISTERS, "url")
STATE = "array<string>"

_BYTE = "(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))?"
_WHOLE = rf"^[34]8;(?:5;{_BYTE}|2;{_BYTE};{_BYTE};{_BYTE})$"
_CAPABILITY = {"bright": "9[0-7]|10[0-7]", "256": "[34]8;5;.*", "truecolor": "[34]8;2;.*"}
CAPABILITIES = ("bright", "256", "truecolor", "old")
TermCap = tuple[str, ...] | None


def capabilities(term_cap: TermCap) -> frozenset[str]:
    """A terminal's abilities; "all" with others means all but those, and "old" is never of all."""
    names = set(CAPABILITIES[:3]) if term_cap is None else set(term_cap)
    if unknown := names - {*CAPABILITIES, "all"}:
        raise ValueError(f"term_cap: unknown {sorted(unknown)}; known are {', '.join(CAPABILITIES)} and all")
    return frozenset(set(CAPABILITIES[:3]) - names | names & {"old"} if "all" in names else names)


def skipped_colours(term_cap: TermCap) -> frozenset[str]:
    """The kinds of colours that are no colours to an old terminal."""
    able = capabilities(term_cap)
    return frozenset(_CAPABILITY) - able if "old" in able else frozenset()


def right_code(code: str, skipped: frozenset[str]) -> bool:
    """Whether a code as ``codes`` writes it counts."""
    whole = ";" not in code or re.search(_WHOLE, code)
    return bool(whole) and not ("bright" in skipped and re.fullmatch(_CAPABILITY["bright"], code))


def code_pattern(skipped: frozenset[str]) -> str:
    """One SGR code with its semicolon; a colour with all its parameters, whether they are right or not.

    A selector other than 2 and 5 that more follows is a code of its own, and so are all
    parameters of the kinds of colours ``skipped``.
    """
    kinds = {"256": ("5", 1), "truecolor": ("2", 3)}
    found = []
    for name, (selector, n) in kinds.items():
        if name not in skipped:
            found += [rf"0*[34]8;0*{selector};{f'{_BYTE};' * n}", rf"0*[34]8;0*{selector};(?:[^;]*+;){{0,{n}}}"]
    return rf"(?:{'|'.join([*found, rf'0*[34]8;[^;]*+;$', rf'0*[34]8;(?!{_BYTE};)[^;]*+;', '[^;]*+;'])})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _slots() -> Column:
    """The registers' codes; the hyperlink's are no code's."""
    rows = ", ".join(f"named_struct('on', '{on}', 'off', '{off}')" for on, off in (*REGISTERS.values(), ("url", "url")))
    return F.expr(f"array({rows})")


def register(state: Column, name: str) -> Column:
    """What ``name`` is set to; "" if it isn't."""
    return F.coalesce(state[NAMES.index(name)], F.lit(""))


def codes(x: Column, term_cap: TermCap = None) -> Column:
    """All SGR codes of ``x`` in order, colours with their parameters as one.

    Codes count whatever a terminal can do, unless ``term_cap`` has "old": then bright codes are
    skipped if it lacks them, and the parameters of colours that it lacks are codes of their own.
    A colour with a wrong or missing parameter changes nothing.
    """
    skipped = skipped_colours(term_cap)
    sequences = F.filter(F.regexp_extract_all(x, F.lit(rf"(?s:{SGR}|{control_pattern()})"), F.lit(0)), lambda s: s.rlike(rf"^{SGR}$"))
    own = F.transform(sequences, lambda s: F.concat(F.substring(s, F.lit(3), F.char_length(s) - 3), F.lit(";")))
    split = F.flatten(F.transform(own, lambda p: F.regexp_extract_all(p, F.lit(code_pattern(skipped)), F.lit(0))))
    bare = F.transform(split, lambda c: F.substring(c, F.lit(1), F.char_length(c) - 1))
    plain = F.transform(bare, lambda c: F.when(c == "", "0").otherwise(F.regexp_replace(F.regexp_replace(c, ";(?=;|$)", ";0"), r"(^|;)0+(?=[0-9])", "$1")))
    right = F.filter(plain, lambda c: ~c.contains(";") | c.rlike(_WHOLE))
    return F.filter(right, lambda c: ~c.rlike(rf"^(?:{_CAPABILITY['bright']})$")) if "bright" in skipped else right


def links(x: Column) -> Column:
    """The hyperlinks of ``x`` in order, as the sequences that open them; "" for one that closes."""
    sequences = F.filter(F.regexp_extract_all(x, F.lit(control_pattern()), F.lit(0)), lambda s: s.startswith("\x1b]8;"))

    def opened(s: Column) -> Column:
        address = F.regexp_extract(s, rf"(?s)^{URL}$", 2)
        name = F.regexp_extract(F.regexp_extract(s, rf"(?s)^{URL}$", 1), "(?:^|:)id=([^:]*)", 1)
        named = F.when(name != "", F.concat(F.lit("id="), name)).otherwise("")
        return F.when(address == "", "").otherwise(F.concat(F.lit("\x1b]8;"), named, F.lit(";"), address, F.lit("\x1b\\")))

    good = F.filter(sequences, lambda s: s.rlike(rf"^{URL}$") & ~F.regexp_extract(s, rf"(?s)^{URL}$", 2).rlike(r"[^\x20-\x7E]"))
    return F.transform(good, opened)


def events(x: Column, term_cap: TermCap = None) -> Column:
    """What ``x`` assigns to each register."""

    def assign(state: Column, code: Column) -> Column:
        family = code
        for name, pattern in CODE_FAMILIES.items():
            family = F.when(code.rlike(pattern), F.lit(name)).otherwise(family)
        with_family = F.struct(code.alias("code"), family.alias("family"))
        return let(with_family, lambda c: F.zip_with(state, _slots(), lambda value, slot: (
            F.when((slot["off"] == c["code"]) | ((c["code"] == "0") & (slot["off"] != "url")), "").when(slot["on"] == c["family"], c["code"]).otherwise(value)
        )))

    formats = F.when(x.contains("\x1b["), F.aggregate(codes(x, term_cap), nothing(), assign)).otherwise(nothing())
    link = F.when(x.contains("\x1b]8;"), F.try_element_at(links(x), F.lit(-1)))
    return F.concat(F.slice(formats, 1, len(REGISTERS)), F.array(link))


def nothing() -> Column:
    """No assignment, or the state without any format."""
    return F.expr(f"array_repeat(cast(NULL AS string), {len(NAMES)})")


def then(before: Column, after: Column) -> Column:
    """The state of ``before`` with the assignments of ``after``."""
    return F.zip_with(before, after, lambda b, a: F.coalesce(a, b))


def _sequences(active: Column, each: bool) -> Column:
    """An array of SGR codes as one sequence, or as one ``each``; "" if there are none."""
    if each:
        return F.array_join(F.transform(active, lambda c: F.concat(F.lit("\x1b["), c, F.lit("m"))), "")
    return let(F.array_join(active, ";"), lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("\x1b["), c, F.lit("m"))))


def open_state(state: Column, normalize: bool = False) -> Column:
    """The sequences that bring ``state`` about."""
    formats = lambda s: F.filter(F.slice(s, 1, len(REGISTERS)), lambda v: v != "")
    return let(state, lambda s: F.concat(_sequences(formats(s), normalize), register(s, "url")))


END_LINK = "\x1b]8;;\x1b\\"


def close_of(state: Column, normalize: bool = False) -> Column:
    """The sequences that end ``state``."""

    def closing(s: Column) -> Column:
        pairs = F.zip_with(s, _slots(), lambda v, slot: F.when((v != "") & (slot["off"] != "url"), slot["off"]))
        offs = F.sort_array(F.array_distinct(F.array_compact(pairs)))
        text = _sequences(offs, True) if normalize else F.when(F.size(offs) > 0, F.lit("\x1b[0m")).otherwise("")
        return F.concat(text, F.when(register(s, "url") != "", F.lit(END_LINK)).otherwise(""))

    return let(state, closing)


def bridge(before: Column, after: Column, normalize: bool = False) -> Column:
    """The least sequences that lead from one state to another.

    Unless ``normalize``, any register that ends or changes means a reset and all of
    ``after`` anew; with it, registers that end get their own closing code.
    """
    none = F.lit("")
    pairs = F.zip_with(before, after, lambda b, a: F.struct(F.coalesce(b, none).alias("was"), F.coalesce(a, none).alias("now")))
    changes = F.zip_with(pairs, _slots(), lambda p, slot: F.struct(p["was"].alias("was"), p["now"].alias("now"), slot["off"].alias("off")))
    return let(changes, lambda c: _changes(c, normalize))


def _changes(changes: Column, normalize: bool) -> Column:
    url = changes[len(REGISTERS)]
    link = F.when(url["was"] == url["now"], "").when(url["now"] == "", F.lit(END_LINK)).otherwise(url["now"])

    def codes_of(of: Callable[[Column], Column], field: str = "now") -> Column:
        return F.transform(F.filter(changes, lambda c: (c["off"] != "url") & of(c)), lambda c: c[field])

    if normalize:
        ended = F.sort_array(F.array_distinct(codes_of(lambda c: (c["was"] != "") & (c["now"] == ""), "off")))
        # a closing code takes its whole group away
        def opened(ends: Column) -> Column:
            new = codes_of(lambda c: (c["now"] != "") & ((c["now"] != c["was"]) | F.array_contains(ends, c["off"])))
            return F.concat(_sequences(ends, True), _sequences(new, True))

        return F.concat(let(ended, opened), link)
    new = codes_of(lambda c: (c["now"] != "") & (c["now"] != c["was"]))
    kept = codes_of(lambda c: (c["now"] != "") & (c["now"] == c["was"]))
    ends = F.exists(changes, lambda c: (c["off"] != "url") & (c["was"] != "") & (c["was"] != c["now"]))
    anew = _sequences(F.concat(F.array(F.lit("0")), kept, new), False)
    return F.concat(F.when(ends, anew).otherwise(_sequences(new, False)), link)


def state_at_end(x: Column, normalize: bool = False, carry: Column | None = None, term_cap: TermCap = None) -> Column:
    """The sequences that bring about the state that ``x`` ends in; ``carry`` is the state it begins in."""
    found = let(then(carry, events(x, term_cap)) if carry is not None else events(x, term_cap), lambda s: open_state(s, normalize))
    return F.when(x.isNotNull(), found)


def close_state(x: Column, normalize: bool = False, term_cap: TermCap = None) -> Column:
    """The sequences that end the state that ``x`` ends in; "" for null."""
    return F.when(x.contains("\x1b"), let(events(x, term_cap), lambda s: close_of(s, normalize))).otherwise("")


#: Pieces of a text between which its state may change: runs of SGR and hyperlinks, and what stands between.
SPECIAL = rf"(?s:(?:{SGR}|{URL})++)"
_OTHER = control_pattern(("all", "sgr", "url", "nl", "c0"))
PIECES = rf"(?s:{SPECIAL}|(?:(?!{SPECIAL})(?:{_OTHER}|[^\x1B]++))++)"


#: Items that a fold puts together before it adds them to what it has.
_RUN = 64


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "string") -> Column:
    """Go through ``items`` with a state: a struct of the end's state and out, an array of what each step gave.

    ``step`` takes a state and an item and gives a struct of state and out (of type ``kind``). Adding to an
    array copies it, so items are taken in runs and the runs' arrays are put together in the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(found: Column) -> Column:
        def run(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(found, k * _RUN + 1, F.lit(_RUN)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(part, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        runs = F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(found) - 1) / _RUN).cast("int"))
        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return let(F.aggregate(runs, begin, run), lambda r: F.struct(r["state"].alias("state"), F.flatten(r["outs"]).alias("out")))

    return let(items, whole)


def fold_pieces(x: Column, start: Column, step: Callable[[Column, Column], Column], term_cap: TermCap = None) -> Column:
    """Go through the pieces of ``x``; gives a struct of the end's state and the text written.

    ``step`` writes the text for a change (from state, to state).
    """

    def one(state: Column, piece: Column) -> Column:
        changed = let(then(state, events(piece, term_cap)), lambda s: F.struct(s.alias("state"), step(state, s).alias("out")))
        return F.when(piece.rlike(rf"^{SPECIAL}$"), changed).otherwise(F.struct(state.alias("state"), piece.alias("out")))

    folded = fold(F.regexp_extract_all(x, F.lit(PIECES), F.lit(0)), start.cast(STATE), one)
    return let(folded, lambda f: F.struct(f["state"].alias("state"), F.array_join(f["out"], "").alias("text")))


def normalized(x: Column, carry: Column | None = None, term_cap: TermCap = None) -> Column:
    """``x`` with each run of SGR and hyperlinks as the least changes, a sequence for each code.

    Codes that change nothing go. With ``carry`` the text is taken to begin in that state. This is an
    expression, for use within others; for columns, ``machine.normalize_state`` is faster.
    """
    start = nothing() if carry is None else carry
    folded = fold_pieces(x, start, lambda a, b: bridge(a, b, True), term_cap)["text"]
    return F.when(x.contains("\x1b"), folded).otherwise(x)
