"""Formatted text as HTML."""

from __future__ import annotations

import re

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .controls import has_ctl
from .machine import NONE, REMEMBERED, TOKENS, Machine, State, carried_in, in_batches, machine, state_of
from .state import NAMES, TermCap

# The 16 basic colours, the steps of the colour cube, and the style of each register.
BASIC = (
    "000000 BB0000 00BB00 BBBB00 0000BB BB00BB 00BBBB BBBBBB 555555 FF5555 55FF55 FFFF55 5555FF FF55FF 55FFFF FFFFFF".split()
)
CUBE = "00 5F 87 AF D7 FF".split()
CSS = {
    "bold": "font-weight: bold",
    "faint": "font-weight: 100",
    "italic": "font-style: italic",
    "underline": "text-decoration: underline",
    "blink": "text-decoration: blink",
    "fast_blink": "text-decoration: blink",
    "conceal": "color: transparent",
    "crossout": "text-decoration: line-through",
}
#: A link as the state has it.
LINK = re.compile(r"\x1B\]8;[^;]*;([^\x1B]*)\x1B\\")
ENTITIES = {"&": "&amp;", '"': "&quot;", "'": "&#039;", "<": "&lt;", ">": "&gt;"}


def palette() -> list[str]:
    """The 256 colours as RRGGBB."""
    cube = [r + g + b for r in CUBE for g in CUBE for b in CUBE]
    return [*BASIC, *cube, *(f"{8 + 10 * k:02X}" * 3 for k in range(24))]


PALETTE = palette()


def palette_index(code: str) -> int | None:
    """0 to 255 for the SGR code of a basic, bright or palette colour; None for others."""
    first, *rest = code.split(";")
    if rest:
        return int(rest[1]) if rest[0] == "5" else None
    number = int(first)
    return number % 10 + (8 if number >= 90 else 0)


def color_hex(code: str) -> str:
    """An SGR colour code as #RRGGBB."""
    n = palette_index(code)
    return "#" + (PALETTE[n] if n is not None else "".join(f"{int(c):02X}" for c in code.split(";")[2:]))


def default_classes() -> list[str]:
    return [f"term-{kind}-{n:03d}" for n in range(256) for kind in ("color", "bgcolor")]


#: Classes for the 8 or 16 basic colours or the whole palette, each as foreground and background.
_CLASS_COUNTS = {2 * n for n in (8, 16, 256)}


def class_names(classes: list[str]) -> list[str]:
    wrong = [c for c in classes if re.search(r"[^\w-]", c, re.ASCII)]
    if wrong or len(classes) not in _CLASS_COUNTS:
        raise ValueError(f"classes: {len(classes)} given, of which {wrong} can't be put in an attribute; known counts are {sorted(_CLASS_COUNTS)}")
    return classes


@lru_cache(maxsize=REMEMBERED)
def tags(state: State, classes: tuple[str, ...]) -> tuple[str, str]:
    """What opens and what closes the elements for a state; "" if it shows in none."""
    on = dict(zip(NAMES, state, strict=True))
    colors = (on["bg"], on["fg"]) if on["invert"] else (on["fg"], on["bg"])
    names, inline = [], []
    for k, (code, css) in enumerate(zip(colors, ("color", "background-color"), strict=True)):
        n = palette_index(code) if code and classes else None
        if n is not None and 2 * n < len(classes):
            names.append(classes[2 * n + k])
        elif code:
            inline.append(f"{css}: {color_hex(code)}")
    inline += [css for name, css in CSS.items() if on[name]]
    attributes = (f" class='{' '.join(names)}'" if names else "") + (f" style='{'; '.join(inline)};'" if inline else "")
    link = LINK.match(on["url"])
    begin = f"<a href='{link[1]}'>" if link else ""
    return begin + (f"<span{attributes}>" if attributes else ""), ("</span>" if attributes else "") + ("</a>" if link else "")


def as_html(known: Machine, text: str, classes: tuple[str, ...], state: State = NONE) -> str:
    """Elements are opened where characters follow, so none is empty; they are closed where the state changes, and in the end."""
    out, at, shown, ending = [], 0, ("", ""), ""

    def put(piece: str) -> None:
        nonlocal shown, ending
        if piece:
            opening, closing = tags(state, classes)
            if (now := (opening, state[-1])) != shown:
                out.extend((ending, opening))
                shown, ending = now, closing
            out.append(piece)

    for m in TOKENS.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        if m["run"]:
            state = known.after(state, m["run"])
    put(text[at:])
    return "".join([*out, ending])


def to_html(x: Column, classes: bool | list[str] = False, carry: Column | str | None = None, term_cap: TermCap = None) -> Column:
    """SGR formats as spans and hyperlinks as links, never nested and all closed.

    Other escapes go. ``classes`` (16, 32 or 512 names, foreground and background in
    turn; or True) puts palette colours as classes. ``carry`` is the state that
    the text begins in, or a text that ends in it. The text itself, and a link's address in it, is not escaped; see ``html_esc``.
    """
    names = tuple(class_names(default_classes() if classes is True else list(classes))) if classes else ()
    asked = F.when(x.contains("\x1b") if carry is None else x.isNotNull(), x)
    return F.coalesce(in_batches("string", lambda t, s=None: as_html(machine(term_cap), t, names, state_of(s)), asked, *carried_in(carry)), x)


def html_esc(x: Column, what: str = "<>&'\"") -> Column:
    """``x`` with the characters of ``what`` as entities."""
    if unknown := set(what) - set(ENTITIES):
        raise ValueError(f"what: {sorted(unknown)} can't be escaped")
    for c, entity in ENTITIES.items():
        if c in what:
            x = F.replace(x, F.lit(c), F.lit(entity))
    return x


def _block(body: Column, css_class: str | list[str]) -> Column:
    names = css_class if isinstance(css_class, str) else " ".join(css_class)
    return F.concat(F.lit(f'<PRE class="{names}"><CODE>'), body, F.lit("</CODE></PRE>"))


def html_code_block(x: Column, order: Column, css_class: str | list[str] = "term") -> Column:
    """An aggregate: the texts of a group in ``order`` as one block of code; a null text is "NA"."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return _block(F.array_join(F.transform(rows, lambda r: r["x"]), "\n", "NA"), css_class)


def output_block(x: Column, css_class: str | list[str] = ("term", "term-output"), classes: bool | list[str] = False) -> Column:
    """What a document shows of a program's output: a block of HTML if it has formats or links, else ``x`` itself."""
    formatted = _block(to_html(html_esc(x), classes), css_class if isinstance(css_class, str) else list(css_class))
    return F.when(has_ctl(x, ("sgr", "url")), formatted).otherwise(x)


def _lookup(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def make_styles(spark: SparkSession, classes: list[str] | None = None, mix: list[list[float]] | None = None) -> DataFrame:
    """(n, css): the rule of each class; ``mix`` is a 3 by 3 matrix that the colours are multiplied with."""
    names = class_names(classes or default_classes())
    base = spark.range(len(names)).select(F.col("id").cast("int").alias("n"), _lookup(PALETTE, F.floor(F.col("id") / 2).cast("int")).alias("hex"))
    parts = [F.conv(F.substring("hex", 2 * k + 1, 2), 16, 10).cast("double") for k in range(3)]
    if mix:
        mixed = [sum((parts[i] * float(mix[i][j]) for i in range(1, 3)), parts[0] * float(mix[0][j])) for j in range(3)]
        channels = [F.lpad(F.hex(F.round(F.least(F.greatest(m, F.lit(0.0)), F.lit(255.0))).cast("int")), 2, "0") for m in mixed]
        base = base.withColumn("hex", F.concat(*channels))
    what = F.when(F.col("n") % 2 == 0, "color").otherwise("background-color")
    return base.select("n", F.concat(F.lit("."), _lookup(names, F.col("n")), F.lit(" {"), what, F.lit(": #"), "hex", F.lit(";}")).alias("css"))
