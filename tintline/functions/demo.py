"""Coloured test texts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .width import UNICODE_VERSION

# The style sheet, and the codes of the capability test.
CSS = "PRE.term SPAN {padding-top: .25em; padding-bottom: .25em};"


def color_lines(x: Column, line: Column, step: int = 1) -> Column:
    """Each line of a text in a colour of its own; ``line`` counts from 1. Empty lines stay."""
    if step < 1:
        raise ValueError("step: a positive integer is asked for")
    ground = (line * step) % 215 + 17
    front = F.when(F.floor((ground - 16) / 18) % 2 == 1, 30).otherwise(37)
    colored = F.concat(F.lit("\x1b["), front.cast("string"), F.lit(";48;5;"), ground.cast("int").cast("string"), F.lit("m"), x, F.lit("\x1b[39;49m"))
    return F.when(x == "", x).otherwise(colored)


TERM_CAP_CODES = {"bright": "91;104", "256": "38;5;196;48;5;21", "truecolor": "38;2;255;0;0;48;2;0;0;255"}


def term_cap_test() -> list[str]:
    found = [f"\x1b[{code}m{name:<9}\x1b[0m" for name, code in TERM_CAP_CODES.items()]
    for text in found:
        print(f"{text}  ->  {text.replace(chr(27), chr(92) + '033')}")
    return found


def palette_chart(spark: SparkSession) -> DataFrame:
    """(line, text): the 256 colours, each number on its colour."""

    def cell(n: int, front: int, ground: int) -> str:
        return f"\x1b[38;5;{front};48;5;{ground}m{n:>3}\x1b[m"

    cube = [(16 + k, 247 - 16 - k) for k in range(216)]
    dark = [[cell(g, f, g) for g, f in cube[r * 36 : r * 36 + 18]] for r in range(6)]
    light = [[cell(g, f, g) for g, f in cube[r * 36 + 18 : r * 36 + 36]] for r in range(6)]
    rows = ["Standard", " ".join(cell(n, 15, n) for n in range(8)), "", "High-Intensity", " ".join(cell(n, 0, n) for n in range(8, 16)), ""]
    rows += ["216 Colors (Dark)", *map("".join, dark), "", "216 Colors (Light)", *map("".join, light), "", "Grayscale"]
    rows += [" ".join(cell(n, 15, n) for n in range(232, 244)), " ".join(cell(n, 0, n) for n in range(244, 256))]
    return spark.createDataFrame(list(enumerate(rows, 1)), "line int, text string")


def print_text(texts: list[str], end: str = "\x1b[0m") -> None:
    print("\n".join(texts) + end)


def default_term_cap() -> tuple[str, ...]:
    direct = os.environ.get("COLORTERM") in ("truecolor", "24bit")
    return ("bright", "256", "truecolor") if direct else ("bright", "256")


def default_css() -> str:
    return CSS


def unicode_version() -> str:
    """Of the width tables, which are Python's own and the ranges that became wide later."""
    return UNICODE_VERSION
