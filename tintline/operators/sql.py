"""The functions under their names in SQL text.

Those that are expressions become SQL functions, which the optimizer puts into the query's plan;
those of the format machine become Arrow functions, and ``unhandled_ctl`` a table function for
LATERAL. All are temporary: they belong to the session.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.controls import control_pattern
from ..functions.html import ENTITIES, as_html
from ..functions.machine import Options, Positions, machine, split_pattern
from ..functions.wrap import Wrapping, wrapped
from .tables import PROBLEM, Unhandled


def _escaped(x: str) -> str:
    for c, entity in ENTITIES.items():
        x = f'replace({x}, "{c}", "{entity}")' if c != '"' else f"replace({x}, '{c}', '{entity}')"
    return x


def expressions() -> dict[str, str]:
    """name(parameters) RETURNS type: body, of the functions that are expressions."""
    every, formats = control_pattern(), control_pattern(("sgr", "url"))
    return {
        "strip_ctl(x STRING) RETURNS STRING": f"regexp_replace(x, R'{every}', '')",
        "strip_sgr(x STRING) RETURNS STRING": f"regexp_replace(x, R'{formats}', '')",
        "has_ctl(x STRING) RETURNS BOOLEAN": f"regexp_like(x, R'{every}')",
        "has_sgr(x STRING) RETURNS BOOLEAN": f"regexp_like(x, R'{formats}')",
        "nchar_ctl(x STRING) RETURNS INT": f"char_length(regexp_replace(x, R'{every}', ''))",
        "nzchar_ctl(x STRING) RETURNS BOOLEAN": f"coalesce(char_length(regexp_replace(x, R'{every}', '')) > 0, true)",
        "html_esc(x STRING) RETURNS STRING": _escaped("x"),
    }


def _normalize(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else machine(None).normalized(t) for t in x.to_pylist()], pa.string())


def _html(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else as_html(machine(None), t, ()) for t in x.to_pylist()], pa.string())


def _cut(type: str):
    def run(x: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        rows = zip(Positions.all_of(x.to_pylist(), Options(type)), start.to_pylist(), stop.to_pylist(), strict=True)
        return pa.array([None if None in row else machine(None).cut(*row) for row in rows], pa.string())

    return run


def _split(x: pa.Array, by: pa.Array) -> pa.Array:
    rows = zip(Positions.all_of(x.to_pylist(), Options()), by.to_pylist(), strict=True)
    return pa.array([None if None in row else machine(None).split(row[0], split_pattern(row[1], False)) for row in rows], pa.list_(pa.string()))


def _wrap(x: pa.Array, width: pa.Array) -> pa.Array:
    rows = zip(x.to_pylist(), width.to_pylist(), strict=True)
    return pa.array([None if n is None else wrapped(machine(None), t, Wrapping(max(1, n - 1), "", "")) for t, n in rows], pa.list_(pa.string()))


def functions_for_sql(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``, in place of any of their names; returns the names."""
    names = []
    for head, body in expressions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    for name, run, kind in (
        ("normalize_state", _normalize, "string"), ("to_html", _html, "string"), ("substr_ctl", _cut("chars"), "string"),
        ("substr_width", _cut("width"), "string"), ("strsplit_ctl", _split, "array<string>"),
        ("strwrap_ctl", _wrap, "array<string>"),
    ):
        spark.udf.register(name, F.arrow_udf(run, kind))
        names.append(name)
    spark.udtf.register("unhandled_ctl", F.udtf(Unhandled, returnType=PROBLEM))
    return [*names, "unhandled_ctl"]
