"""More queries over the given tables: links, overlapping formats, classes, options, SQL text, orders without one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.controls import strip_ctl
from ..functions.demo import palette_chart
from ..functions.html import html_esc, make_styles, to_html
from ..functions.machine import normalize_state
from ..functions.state import state_at_end
from ..functions.text import overlay_ctl, strwrap_ctl, substr_ctl, trimws_ctl
from ..operators.carry import carried, with_state
from ..operators.order import numbered, recycled
from ..operators.sql import functions_for_sql
from ..operators.tables import code_block_parts
from .catalogue import ESC, LINES_SQL, OPEN_SQL, PALETTE_SQL, colored_lines, document_lines, escaped_sql, open_lines

LINK_END = f"{ESC}]8;;{ESC}\\"
#: Blanks in a row, enough to overflow a stack that goes as deep.
BLANKS = 3000


def wrap_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each coloured line without its blanks, which is one long word, broken and filled up behind a prefix."""
    word = F.translate("c", " \t", "")
    wrapped = strwrap_ctl(word, 12, prefix="> ", wrap_always=True, pad_end=".")
    return colored_lines(spark, sf_dir).select("doc_id", "line_no", F.array_join(wrapped, "|").alias("wrapped"))


#: Lines in each part of a language's block.
PART_LINES = 500


def block_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a language as one block of code, in parts."""
    found = document_lines(spark, sf_dir).select("lang", "doc_id", "line_no", html_esc(F.col("x")).alias("escaped"))
    return code_block_parts(found, "escaped", ["lang"], ["doc_id", "line_no"], rows=PART_LINES)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a hyperlink of its document, cut, wrapped, normalized and as HTML."""
    link = F.concat(F.lit(f"{ESC}]8;"), F.when(F.col("line_no") % 2 == 0, "id=a").otherwise(""), F.lit(";http://h.x/?a=1&d="), F.col("doc_id").cast("string"), F.lit(f"{ESC}\\"))
    found = document_lines(spark, sf_dir).withColumn("c", F.concat(link, F.col("x"), F.lit(LINK_END))).withColumn("w", F.concat(link, F.lit("abc def ghi"), F.lit(LINK_END)))
    c = F.col("c")
    return found.select(
        "doc_id", "line_no", substr_ctl(c, 2, 5).alias("part"), normalize_state(c).alias("normal"), to_html(html_esc(c)).alias("html"),
        F.array_join(strwrap_ctl(F.col("w"), 8), "|").alias("wrapped"), state_at_end(F.concat(link, F.col("x"))).alias("state"),
    )


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold from the start, underlined from the sixth character on, bold until the eleventh; cut across all of it."""
    c = F.concat(F.lit(f"{ESC}[1m"), F.substring("x", 1, 5), F.lit(f"{ESC}[4m"), F.substring("x", 6, 5), F.lit(f"{ESC}[22m"), F.substring(F.col("x"), F.lit(11), F.char_length("x")))
    found = document_lines(spark, sf_dir).withColumn("c", c)
    return found.select("doc_id", "line_no", *[f(F.col("c")).alias(n) for n, f in {"cut": lambda c: substr_ctl(c, 3, 14), "open_end": lambda c: substr_ctl(c, 3, 14, terminate=False), "html": lambda c: to_html(html_esc(c)), "normal": normalize_state}.items()])


def html_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = [f"{kind}{n}" for n in range(8) for kind in ("fg", "bg")]
    c = html_esc(F.col("c"))
    return colored_lines(spark, sf_dir).select("doc_id", "line_no", to_html(c, classes=True).alias("html"), to_html(c, classes=few).alias("few"))


def overlay_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.lit(f"{ESC}[1mXY")
    return colored_lines(spark, sf_dir).select(
        "doc_id", "line_no", overlay_ctl(F.col("c"), mark, 2, 3, normalize=True).alias("each"), overlay_ctl(F.col("c"), mark, 2, 3, terminate=False).alias("open_end"),
        overlay_ctl(F.col("x"), F.lit("一Y"), 2, 4, "width").alias("wide"),
    )


def trimws_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of blanks at both ends and inside, in front of and behind formats."""
    gap = F.lit(" " * BLANKS)
    c = F.concat(gap, F.lit(f"{ESC}[1m"), F.col("x"), gap, F.lit(f"z{ESC}[22m"), gap)
    return document_lines(spark, sf_dir).select("doc_id", "line_no", trimws_ctl(c).alias("part"))


def carried_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines from its first missing one on are missing, too."""
    rows = open_lines(spark, sf_dir).withColumn("c", F.when((F.col("line_no") != 6) | (F.col("doc_id") % 2 == 0), F.col("c")))
    found = carried(rows, "c", ["doc_id"], ["line_no"], "html", lambda c, s: to_html(html_esc(c), carry=s))
    return found.select("doc_id", "line_no", "html")


def state_over_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' lines as the lines of one, whose formats are carried from range to range."""
    found = with_state(open_lines(spark, sf_dir), "c", [], ["doc_id", "line_no"], parts=16)
    return found.select("doc_id", "line_no", state_at_end(F.lit(""), carry=F.col("state_in")).alias("state"))


def substr_recycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and stops that are shorter than the table, over and over again in its order."""
    rows = numbered(colored_lines(spark, sf_dir), ["doc_id", "line_no"], parts=16)
    n = F.col("row_no")
    return rows.select("doc_id", "line_no", substr_ctl(F.col("c"), recycled(n, [1, 3, 5]), recycled(n, [8, 12])).alias("part"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions_for_sql(spark)
    return spark.sql(
        """SELECT doc_id, line_no, strip_ctl(c) AS stripped, has_sgr(c) AS formatted, nchar_ctl(c) AS n, nzchar_ctl(c) AS some,
            html_esc(strip_sgr(c)) AS escaped, normalize_state(c) AS normal, substr_ctl(c, 3, 20) AS part FROM {lines}""",
        lines=colored_lines(spark, sf_dir),
    )


def unhandled_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function on lines behind wide characters, in SQL text."""
    functions_for_sql(spark)
    bad = F.concat(F.lit(f"一丁{ESC}[22>m"), F.col("x"), F.lit(f"{ESC}[31mz{ESC}[5k"))
    return spark.sql(
        "SELECT doc_id, line_no, u.start, u.stop, u.error, u.translated, u.esc FROM {lines} AS t, LATERAL unhandled_ctl(t.c) AS u",
        lines=document_lines(spark, sf_dir).select("doc_id", "line_no", bad.alias("c")),
    )


def styles_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with its rule, and how many lines are on its colour."""
    ground = F.regexp_extract("c", r"48;5;(\d+)m", 1)
    used = colored_lines(spark, sf_dir).filter(ground != "").groupBy((2 * ground.cast("int") + 1).alias("n")).agg(F.count(F.lit(1)).alias("n_lines"))
    return make_styles(spark).join(used, "n", "left").select("n", "css", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def charted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside each document a line of the chart, by turns; the chart has 25 lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chart = F.broadcast(palette_chart(spark))
    return docs.select("doc_id", (F.col("doc_id") % 25 + 1).cast("int").alias("line")).join(chart, "line").select("doc_id", "line", "text", strip_ctl(F.col("text")).alias("shown"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (wrap_broken, block_parts, links, overlapping, html_classes, overlay_options, trimws_long_runs, carried_with_nulls, state_over_all_lines, substr_recycled, sql_functions, unhandled_lateral)
} | {"make_styles": styles_used, "palette_chart": charted_documents}

_X = "substring(x, {}, {})"
_NORMAL = "CASE WHEN x = '' THEN '' ELSE replace(opened, ';48;5;', 'm' || chr(27) || '[48;5;') || x || chr(27) || '[39m' || chr(27) || '[49m' END"
_CELL = "list_transform({0}, lambda k: chr(27) || '[38;5;' || {1} || ';48;5;' || {2} || 'm' || lpad(({2})::VARCHAR, 3, ' ') || chr(27) || '[m')"
_CUBE = "list_transform(range(0, 6), lambda r: array_to_string({}, ''))"

ORACLE_SQL: dict[str, str] = {
    "wrap_broken": f"""WITH {LINES_SQL}, y AS (SELECT *, translate(coalesce(x, 'NA'), ' ' || chr(9), '') AS y FROM l)
        SELECT doc_id, line_no, CASE WHEN x IS NULL OR x = '' THEN '> ' || rpad(y, 9, '.')
        WHEN y = '' THEN opened || '> ' || repeat('.', 9) || chr(27) || '[0m'
        ELSE array_to_string(list_transform(range(0, (length(y) + 8) // 9), lambda k: opened || '> ' || rpad(substring(y, 9 * k + 1, 9), 9, '.') || chr(27) || '[0m'), '|') END AS wrapped FROM y""",
    "block_parts": f"""WITH {LINES_SQL}, n AS (SELECT lang, doc_id, line_no, {escaped_sql("x")} AS t, (row_number() OVER (ORDER BY lang NULLS FIRST, doc_id, line_no) - 1) // {PART_LINES} AS p FROM l),
        h AS (SELECT lang, min(p) AS a, max(p) AS z FROM n GROUP BY lang)
        SELECT n.lang, p - a + 1 AS part_no, CASE WHEN p = a THEN '<PRE class="term"><CODE>' ELSE chr(10) END || string_agg(coalesce(t, 'NA'), chr(10) ORDER BY doc_id, line_no)
        || CASE WHEN p = z THEN '</CODE></PRE>' ELSE '' END AS html FROM n JOIN h ON n.lang IS NOT DISTINCT FROM h.lang GROUP BY n.lang, p, a, z""",
    "links": f"""WITH {LINES_SQL}, k AS (SELECT *, chr(27) || ']8;' || CASE WHEN line_no % 2 = 0 THEN 'id=a' ELSE '' END || ';http://h.x/?a=1&d=' || doc_id || chr(27) || '\\' AS k, chr(27) || ']8;;' || chr(27) || '\\' AS e FROM l)
        SELECT doc_id, line_no, CASE WHEN substring(x, 2, 4) = '' THEN '' ELSE k || substring(x, 2, 4) || e END AS part, CASE WHEN x = '' THEN '' ELSE k || x || e END AS normal,
        CASE WHEN x = '' THEN '' ELSE '<a href=''http://h.x/?a=1&amp;d=' || doc_id || '''>' || {escaped_sql("x")} || '</a>' END AS html,
        k || 'abc def' || e || '|' || k || 'ghi' || e AS wrapped, CASE WHEN x IS NOT NULL THEN k END AS state FROM k""",
    "overlapping": f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, x, substring(x, 1, 5) AS a, substring(x, 3, 3) AS b, substring(x, 6, 5) AS c, substring(x, 11) AS d, substring(x, 11, 4) AS f, chr(27) || '[' AS e FROM l),
        q AS (SELECT *, CASE WHEN b = '' THEN '' ELSE e || '1m' || b || CASE WHEN c = '' THEN '' ELSE e || '4m' || c END || CASE WHEN f = '' THEN '' ELSE e || '22m' || f END END AS cut FROM p)
        SELECT doc_id, line_no, CASE WHEN cut = '' THEN '' ELSE cut || e || '0m' END AS cut,
        CASE WHEN length(x) < 3 THEN e || '4m' WHEN length(x) < 14 AND d = '' THEN cut || CASE WHEN c = '' THEN e || '4m' ELSE '' END || e || '22m' ELSE cut END AS open_end,
        CASE WHEN x = '' THEN '' ELSE '<span style=''font-weight: bold;''>' || {escaped_sql("a")} || CASE WHEN c = '' THEN '' ELSE '</span><span style=''font-weight: bold; text-decoration: underline;''>' || {escaped_sql("c")} END
            || CASE WHEN d = '' THEN '' ELSE '</span><span style=''text-decoration: underline;''>' || {escaped_sql("d")} END || '</span>' END AS html,
        CASE WHEN x = '' THEN e || '4m' WHEN c = '' THEN e || '1m' || a || e || '22m' || e || '4m' ELSE e || '1m' || a || e || '4m' || c || e || '22m' || d END AS normal FROM q""",
    "html_classes": f"""WITH {LINES_SQL}, f AS (SELECT *, CASE WHEN ((b - 16) // 18) % 2 = 1 THEN 0 ELSE 7 END AS fg FROM l)
        SELECT doc_id, line_no, CASE WHEN x = '' THEN '' ELSE '<span class=''term-color-00' || fg || ' term-bgcolor-' || lpad(b::VARCHAR, 3, '0') || '''>' || {escaped_sql("x")} || '</span>' END AS html,
        CASE WHEN x = '' THEN '' ELSE '<span class=''fg' || fg || ''' style=''background-color: #' || {PALETTE_SQL} || ';''>' || {escaped_sql("x")} || '</span>' END AS few FROM f""",
    "overlay_options": f"""WITH {LINES_SQL}, e AS (SELECT *, chr(27) || '[' AS e, substring(x, 1, 1) AS a, substring(x, 4) AS z FROM l)
        SELECT doc_id, line_no, CASE WHEN length(x) < 2 THEN c ELSE opened || a || e || '39m' || e || '49m' || e || '1m' || substring('XY', 1, least(length(x), 3) - 1) || e || '22m'
            || CASE WHEN z = '' THEN '' ELSE replace(opened, ';48;5;', 'm' || chr(27) || '[48;5;') || z || e || '39;49m' END END AS each,
        CASE WHEN length(x) < 2 THEN c ELSE opened || a || e || '1m' || substring('XY', 1, least(length(x), 3) - 1) || CASE WHEN z = '' THEN '' ELSE z || e || '39;49m' END END AS open_end,
        CASE WHEN length(x) < 3 THEN x WHEN length(x) = 3 THEN a || chr(19968) ELSE a || chr(19968) || 'Y' || substring(x, 5) END AS wide FROM e""",
    "trimws_long_runs": f"""WITH {LINES_SQL} SELECT doc_id, line_no, chr(27) || '[1m' || ltrim(x || repeat(' ', {BLANKS}) || 'z', ' ') || chr(27) || '[0m' AS part FROM l""",
    "carried_with_nulls": f"""{OPEN_SQL}, h AS (SELECT *, concat_ws('; ', 'color: #' || ['000000', 'BB0000', '00BB00', 'BBBB00', '0000BB', 'BB00BB', '00BBBB', 'BBBBBB'][nullif(fg0, '')::INT - 29],
        CASE WHEN s IS NOT NULL OR bold0 = '1' THEN 'font-weight: bold' END) AS st FROM e)
        SELECT doc_id, line_no, CASE WHEN line_no >= 6 AND doc_id % 2 <> 0 THEN NULL WHEN x = '' THEN '' WHEN st = '' THEN {escaped_sql("x")}
        ELSE '<span style=''' || st || ';''>' || {escaped_sql("x")} || '</span>' END AS html FROM h""",
    "state_over_all_lines": f"""WITH {LINES_SQL},
        w AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '' WHEN line_no % 5 = 0 THEN '1' END AS s, CASE WHEN line_no % 7 = 0 THEN '' WHEN line_no % 3 = 0 THEN (30 + line_no % 8)::VARCHAR END AS f FROM l),
        e AS (SELECT *, last_value(f IGNORE NULLS) OVER p AS fg, last_value(s IGNORE NULLS) OVER p AS bold FROM w WINDOW p AS (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id, line_no, CASE WHEN concat_ws(';', nullif(bold, ''), nullif(fg, '')) = '' THEN '' ELSE chr(27) || '[' || concat_ws(';', nullif(bold, ''), nullif(fg, '')) || 'm' END AS state FROM e""",
    "substr_recycled": f"""WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS n FROM l), r AS (SELECT *, [1, 3, 5][n % 3 + 1] AS a, [8, 12][n % 2 + 1] AS z FROM n)
        SELECT doc_id, line_no, CASE WHEN substring(x, a, z - a + 1) = '' THEN '' ELSE opened || substring(x, a, z - a + 1) || chr(27) || '[0m' END AS part FROM r""",
    "sql_functions": f"""WITH {LINES_SQL} SELECT doc_id, line_no, x AS stripped, x <> '' AS formatted, length(x)::INT AS n, coalesce(x <> '', true) AS some, {escaped_sql("x")} AS escaped, {_NORMAL} AS normal,
        CASE WHEN substring(x, 3, 18) = '' THEN '' ELSE opened || substring(x, 3, 18) || chr(27) || '[0m' END AS part FROM l""",
    "unhandled_lateral": f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, length(x) AS n FROM l WHERE x IS NOT NULL)
        SELECT doc_id, line_no, 5 AS start, 10 AS stop, 'invalid-substr' AS error, false AS translated, chr(27) || '[22>m' AS esc FROM p
        UNION ALL SELECT doc_id, line_no, (17 + n)::INT, (20 + n)::INT, 'non-SGR/hyperlink', false, chr(27) || '[5k' FROM p""",
    "make_styles": f"""WITH {LINES_SQL}, u AS (SELECT 2 * b + 1 AS n, count(*) AS n_lines FROM l WHERE x <> '' GROUP BY 1)
        SELECT s.n::INT AS n, '.term-' || CASE WHEN s.n % 2 = 0 THEN '' ELSE 'bg' END || 'color-' || lpad(b::VARCHAR, 3, '0') || ' {{' || CASE WHEN s.n % 2 = 0 THEN '' ELSE 'background-' END || 'color: #'
        || CASE WHEN b < 16 THEN ['000000', 'BB0000', '00BB00', 'BBBB00', '0000BB', 'BB00BB', '00BBBB', 'BBBBBB', '555555', 'FF5555', '55FF55', 'FFFF55', '5555FF', 'FF55FF', '55FFFF', 'FFFFFF'][b + 1] ELSE {PALETTE_SQL} END || ';}}' AS css,
        coalesce(n_lines, 0) AS n_lines FROM (SELECT n, n // 2 AS b FROM range(512) r(n)) s LEFT JOIN u ON u.n = s.n""",
    "palette_chart": f"""WITH t AS (SELECT list_concat(['Standard', array_to_string({_CELL.format("range(0, 8)", "15", "k")}, ' '), '', 'High-Intensity', array_to_string({_CELL.format("range(8, 16)", "0", "k")}, ' '), '', '216 Colors (Dark)'],
        list_concat({_CUBE.format(_CELL.format("range(36 * r, 36 * r + 18)", "231 - k", "16 + k"))}, list_concat(['', '216 Colors (Light)'], list_concat({_CUBE.format(_CELL.format("range(36 * r + 18, 36 * r + 36)", "231 - k", "16 + k"))},
        ['', 'Grayscale', array_to_string({_CELL.format("range(232, 244)", "15", "k")}, ' '), array_to_string({_CELL.format("range(244, 256)", "0", "k")}, ' ')])))) AS t)
        SELECT doc_id, (doc_id % 25 + 1)::INT AS line, t[doc_id % 25 + 1] AS text, regexp_replace(t[doc_id % 25 + 1], chr(27) || '\\[[0-9;]*m', '', 'g') AS shown FROM documents, t""",
}
