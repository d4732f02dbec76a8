"""Queries over the given tables, and their SQL.

The tables have no control sequences, so the queries colour the documents' lines
first, each in a colour of the 256 by its number; the SQL builds the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.controls import has_ctl, nchar_ctl, nzchar_ctl, strip_ctl
from ..functions.demo import color_lines
from ..functions.html import html_esc, output_block, to_html
from ..functions.machine import normalize_state
from ..functions.state import close_state, state_at_end
from ..functions.text import overlay_ctl, strsplit_ctl, strtrim_ctl, strwrap_ctl, substr_ctl, tabs_as_spaces, trimws_ctl
from ..operators.carry import carried
from ..operators.tables import code_blocks, exploded, lines, unhandled_ctl

ESC = "\x1b"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "x")


def colored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).withColumn("c", color_lines(F.col("x"), F.col("line_no")))


def _each_line(**columns: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of columns from a line and its coloured form."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = colored_lines(spark, sf_dir)
        return found.select("doc_id", "line_no", *[f(F.col("x"), F.col("c")).alias(n) for n, f in columns.items()])

    return query


def byte_overhead_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return (
        colored_lines(spark, sf_dir)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(has_ctl(c)).alias("n_colored"),
            F.sum(nchar_ctl(c).cast("long")).alias("visible_chars"),
            F.sum(F.octet_length(c).cast("long")).alias("raw_bytes"),
            F.sum(nchar_ctl(c, "bytes").cast("long")).alias("visible_bytes"),
        )
    )


def code_block_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("escaped", html_esc(F.col("text")))
    return code_blocks(turns, "escaped", ["conv_id"], "turn")


def html_esc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html_esc(F.col("html")).alias("escaped"))


def open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line ends in a colour of its number, every fifth begins bold and stays so, every seventh resets."""
    n = F.col("line_no")
    opened = F.concat(F.lit(f"{ESC}["), (30 + n % 8).cast("string"), F.lit("m"))
    c = F.concat(
        F.when(n % 5 == 0, f"{ESC}[1m").otherwise(""), F.col("x"), F.when(n % 7 == 0, f"{ESC}[0m").when(n % 3 == 0, opened).otherwise("")
    )
    return document_lines(spark, sf_dir).withColumn("c", c)


def state_at_end_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carried(open_lines(spark, sf_dir), "c", ["doc_id"], ["line_no"], "state", lambda c, s: state_at_end(c, carry=s))
    return found.select("doc_id", "line_no", "state")


def substr_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carried(open_lines(spark, sf_dir), "c", ["doc_id"], ["line_no"], "part", lambda c, s: substr_ctl(c, 1, 12, carry=s))
    return found.select("doc_id", "line_no", "part")


def to_html_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carried(open_lines(spark, sf_dir), "c", ["doc_id"], ["line_no"], "html", lambda c, s: to_html(html_esc(c), carry=s))
    return found.select("doc_id", "line_no", "html")


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    colored = F.regexp_replace("text", r"(?s)^(\S+)(.*)$", f"{ESC}[1;34m$1{ESC}[0m$2")
    return exploded(docs.select("doc_id", strwrap_ctl(colored, 60).alias("w")), F.col("w"), "wrapped", "no").drop("w")


def wrap_keeps_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document after wrapping and stripping, as many and as long as before."""
    found = wrapped_documents(spark, sf_dir).withColumn("s", strip_ctl(F.col("wrapped")))
    spaces = F.length(F.regexp_replace("s", r"[ ]", ""))
    return found.groupBy("doc_id").agg(F.sum(spaces.cast("long")).alias("n_chars"), F.max(nchar_ctl(F.col("wrapped")).cast("long")).alias("longest"))


#: Wide characters, a combining accent, a flag, a lone half of a flag and a family: 4 + 1 + 2 + 2 + 2 columns of 1 + 4 graphemes more.
WIDE = "\u4e00\u4e01e\u0301\U0001f1e6\U0001f1e7x\U0001f1e6-\U0001f468\u200d\U0001f469"


def wide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind wide, combining, joined and flag characters in a colour."""
    c = F.concat(F.lit(f"{ESC}[32m{WIDE}"), F.col("x"), F.lit(f"{ESC}[0m"))
    found = document_lines(spark, sf_dir).withColumn("c", c)
    return found.select(
        "doc_id", "line_no", nchar_ctl(F.col("c")).cast("long").alias("chars"), nchar_ctl(F.col("c"), "width").cast("long").alias("width"),
        nchar_ctl(F.col("c"), "graphemes").cast("long").alias("graphemes"), substr_ctl(F.col("c"), 3, 7, "width").alias("part"),
        substr_ctl(F.col("c"), 2, 4, "graphemes").alias("three"), strtrim_ctl(F.col("c"), 6).alias("trimmed"),
    )


#: Codes whose colours lack a parameter or have a wrong one, and what state is left of each.
MALFORMED = {"38;5;300": "", "48;2;1;2;999": "", "38;5": "", "38;5;300;1": "1", "48;2;7": "", "38;7;4": "4;7", "1;48;2;1;2": "1", "038;05;007": "38;5;7"}


def malformed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.element_at(F.array(*[F.lit(f"{ESC}[{c}m") for c in MALFORMED]), (F.col("line_no") % len(MALFORMED)).cast("int") + 1)
    found = document_lines(spark, sf_dir).withColumn("c", F.concat(codes, F.col("x")))
    return found.select("doc_id", "line_no", state_at_end(F.col("c")).alias("state"), close_state(F.col("c")).alias("close"), substr_ctl(F.col("c"), 2, 5).alias("part"))


def output_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a document shows them: every third is coloured, so it becomes a block of HTML."""
    turns = _table(spark, sf_dir, "conversations")
    shown = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(f"{ESC}[1m"), F.col("text"), F.lit(f"{ESC}[22m"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", output_block(shown, "term").alias("shown"))


def unhandled_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    bad = F.concat("x", F.when(n % 4 == 0, f"{ESC}[31k").when(n % 4 == 1, f"{ESC}[38;2;1;2;3mz").when(n % 4 == 2, "\x07").otherwise(f"{ESC}[22>m"))
    found = unhandled_ctl(document_lines(spark, sf_dir).select("doc_id", "line_no", bad.alias("c")), "c")
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "byte_overhead_by_lang": byte_overhead_by_lang,
    "has_ctl": _each_line(any_ctl=lambda x, c: has_ctl(c), sgr=lambda x, c: has_ctl(c, "sgr"), c0=lambda x, c: has_ctl(c, "c0")),
    "strip_ctl": _each_line(stripped=lambda x, c: strip_ctl(c), c0_only=lambda x, c: strip_ctl(c, "c0")),
    "nchar_ctl": _each_line(
        chars=lambda x, c: nchar_ctl(c).cast("long"), bytes=lambda x, c: nchar_ctl(c, "bytes").cast("long"),
        width=lambda x, c: nchar_ctl(c, "width").cast("long"), graphemes=lambda x, c: nchar_ctl(c, "graphemes").cast("long"),
    ),
    "nzchar_ctl": _each_line(some=lambda x, c: nzchar_ctl(c)),
    "substr_plain": _each_line(part=lambda x, c: substr_ctl(x, 3, 20)),
    "substr_colored": _each_line(part=lambda x, c: substr_ctl(c, 3, 20)),
    "substr_normalized": _each_line(part=lambda x, c: substr_ctl(c, 1, 9, normalize=True)),
    "substr_width": _each_line(part=lambda x, c: substr_ctl(c, 2, 15, "width", "both")),
    "overlay_colored": _each_line(part=lambda x, c: overlay_ctl(x, F.lit(f"{ESC}[31mXY{ESC}[0m"), 3, 4)),
    "strtrim_colored": _each_line(part=lambda x, c: strtrim_ctl(c, 25)),
    "trimws_colored": _each_line(part=lambda x, c: trimws_ctl(F.concat(F.lit(f" \t{ESC}[31m "), x, F.lit(f"{ESC}[39m  ")))),
    "tabs_as_spaces": _each_line(part=lambda x, c: tabs_as_spaces(F.concat(x, F.lit("\t"), x, F.lit("\tz")))),
    "strsplit_colored": _each_line(joined=lambda x, c: F.array_join(strsplit_ctl(c, ", "), "|")),
    "close_state": _each_line(
        reset=lambda x, c: close_state(F.concat(F.lit(f"{ESC}[1;31m"), x)), each=lambda x, c: close_state(F.concat(F.lit(f"{ESC}[1;31m"), x), True)
    ),
    "normalize_state": _each_line(part=lambda x, c: normalize_state(c)),
    "to_html_colored": _each_line(html=lambda x, c: to_html(html_esc(c))),
    "html_esc": html_esc_pages,
    "code_blocks": code_block_by_conversation,
    "state_at_end_carried": state_at_end_carried,
    "substr_carried": substr_carried,
    "to_html_carried": to_html_carried,
    "wrapped_documents": wrapped_documents,
    "wrap_keeps_words": wrap_keeps_words,
    "wide_text": wide_text,
    "malformed_states": malformed_states,
    "output_blocks": output_blocks,
    "strsplit_carried": _each_line(joined=lambda x, c: F.array_join(strsplit_ctl(x, ", ", carry=f"{ESC}[1m"), "|")),
    "unhandled_by_error": unhandled_by_error,
}

LINES_SQL = """lines AS (SELECT doc_id, lang, unnest(coalesce(string_split(text, chr(10)), [NULL])) AS x, generate_subscripts(coalesce(string_split(text, chr(10)), [NULL]), 1) AS line_no FROM documents),
g AS (SELECT *, line_no % 215 + 17 AS b FROM lines),
o AS (SELECT *, chr(27) || '[' || CASE WHEN ((b - 16) // 18) % 2 = 1 THEN 30 ELSE 37 END || ';48;5;' || b || 'm' AS opened FROM g),
l AS (SELECT *, CASE WHEN x = '' THEN x ELSE opened || x || chr(27) || '[39;49m' END AS c FROM o)"""


def _sql(columns: str) -> str:
    return f"WITH {LINES_SQL} SELECT doc_id, line_no, {columns} FROM l"


def _cut(a: int, b: int) -> str:
    return f"CASE WHEN substring(x, {a}, {b - a + 1}) = '' THEN '' ELSE opened || substring(x, {a}, {b - a + 1}) || chr(27) || '[0m' END"


OPEN_SQL = f"""WITH {LINES_SQL},
w AS (SELECT *, CASE WHEN line_no % 5 = 0 THEN '1' END AS s, CASE WHEN line_no % 7 = 0 THEN '' WHEN line_no % 3 = 0 THEN (30 + line_no % 8)::VARCHAR END AS f FROM l),
e AS (SELECT *, last_value(f IGNORE NULLS) OVER d AS fg, last_value(CASE WHEN line_no % 7 = 0 THEN '' ELSE s END IGNORE NULLS) OVER d AS bold,
    last_value(f IGNORE NULLS) OVER p AS fg0, last_value(CASE WHEN line_no % 7 = 0 THEN '' ELSE s END IGNORE NULLS) OVER p AS bold0 FROM w
    WINDOW d AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_HEX2 = "['00', '5F', '87', 'AF', 'D7', 'FF']"
PALETTE_SQL = f"""CASE WHEN b < 232 THEN {_HEX2}[(b - 16) // 36 + 1] || {_HEX2}[(b - 16) // 6 % 6 + 1] || {_HEX2}[(b - 16) % 6 + 1]
    ELSE repeat(printf('%02X', 8 + 10 * (b - 232)), 3) END"""
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '''', '&#039;'), '<', '&lt;'), '>', '&gt;')"


def escaped_sql(of: str) -> str:
    return _ESCAPED.format(of)


_BASIC = "['000000', 'BB0000', '00BB00', 'BBBB00', '0000BB', 'BB00BB', '00BBBB', 'BBBBBB', '555555', 'FF5555', '55FF55', 'FFFF55', '5555FF', 'FF55FF', '55FFFF', 'FFFFFF']"

# Lines of 59 columns of all documents: white space squeezed by chr(1) and chr(2), which the texts don't
# have; then as many words as fit, or a longer one; the document's first word in colour.
_WRAPPED = r"""WITH s AS (SELECT doc_id, coalesce(text, 'NA') AS text, regexp_replace(coalesce(text, 'NA'), '[ \t]*\n([ \t]*\n)+[ \t]*', chr(1), 'g') AS t FROM documents),
q AS (SELECT doc_id, text, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '[\t\n]', ' ', 'g'), '([.?!]["'')]?) {2,}', '\1' || chr(2), 'g'), ' {2,}', ' ', 'g'), chr(2), '  '), ' *' || chr(1) || '[ ' || chr(1) || ']*', chr(1), 'g') AS t FROM s),
p AS (SELECT doc_id, text, unnest(string_split(trim(t, ' ' || chr(1)), chr(1))) AS p, generate_subscripts(string_split(trim(t, ' ' || chr(1)), chr(1)), 1) AS k FROM q),
f AS (SELECT doc_id, text, k, unnest(CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '((?:[^ ](?:.{0,57}[^ ])?|[^ ]+))(?: +|$)', 1) END) AS line,
    generate_subscripts(CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '((?:[^ ](?:.{0,57}[^ ])?|[^ ]+))(?: +|$)', 1) END, 1) AS j FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j)::INT AS no, regexp_extract(text, '^[^ \t\n\x0B\f\r]+') AS word FROM f),
w AS (SELECT doc_id, no, line, CASE WHEN no > 1 OR word = '' THEN line ELSE chr(27) || '[1;34m' || word || chr(27) || '[0m' || substring(line, length(word) + 1) END AS wrapped FROM n)
"""

ORACLE_SQL: dict[str, str] = {
    "byte_overhead_by_lang": f"""WITH {LINES_SQL} SELECT lang, count(*) AS n_lines, count(*) FILTER (x <> '') AS n_colored, sum(length(x))::BIGINT AS visible_chars,
        sum(strlen(c))::BIGINT AS raw_bytes, sum(strlen(x))::BIGINT AS visible_bytes FROM l GROUP BY lang""",
    "has_ctl": _sql("x <> '' AS any_ctl, x <> '' AS sgr, false AS c0"),
    "strip_ctl": _sql("x AS stripped, c AS c0_only"),
    "nchar_ctl": _sql("length(x) AS chars, strlen(x) AS bytes, length(x) AS width, length(x) AS graphemes"),
    "nzchar_ctl": _sql("x <> '' AS some"),
    "substr_plain": _sql("substring(x, 3, 18) AS part"),
    "substr_colored": _sql(f"{_cut(3, 20)} AS part"),
    "substr_normalized": _sql(
        "CASE WHEN x = '' THEN '' ELSE replace(opened, ';48;5;', 'm' || chr(27) || '[48;5;') || substring(x, 1, 9) || chr(27) || '[39m' || chr(27) || '[49m' END AS part"
    ),
    "substr_width": _sql(f"{_cut(2, 15)} AS part"),
    "overlay_colored": _sql(
        "CASE WHEN length(x) < 3 THEN x ELSE substring(x, 1, 2) || chr(27) || '[31m' || substring('XY', 1, least(length(x), 4) - 2) || chr(27) || '[0m' || substring(x, 5) END AS part"
    ),
    "strtrim_colored": _sql(f"{_cut(1, 25)} AS part"),
    "trimws_colored": _sql(
        "CASE WHEN trim(x, ' ') = '' THEN '' ELSE chr(27) || '[31m' || trim(x, ' ') || chr(27) || '[0m' END AS part"
    ),
    "tabs_as_spaces": _sql(
        "rpad(x, ((length(x) // 8 + 1) * 8)::INT, ' ') || rpad(x, (((length(x) // 8 + 1) * 8 + length(x)) // 8 + 1)::INT * 8 - ((length(x) // 8 + 1) * 8)::INT, ' ') || 'z' AS part"
    ),
    "strsplit_carried": _sql(
        """CASE WHEN x = '' THEN '' ELSE array_to_string(list_transform(CASE WHEN x LIKE '%, ' THEN string_split(x, ', ')[:-2] ELSE string_split(x, ', ') END,
        lambda p: CASE WHEN p = '' THEN '' ELSE chr(27) || '[1m' || p || chr(27) || '[0m' END), '|') END AS joined"""
    ),
    "wide_text": f"""WITH {LINES_SQL} SELECT doc_id, line_no, 12 + length(x) AS chars, 13 + length(x) AS width, 8 + length(x) AS graphemes,
        chr(27) || '[32m' || chr(19969) || 'e' || chr(769) || chr(127462) || chr(127463) || chr(27) || '[0m' AS part,
        chr(27) || '[32m' || chr(19969) || 'e' || chr(769) || chr(127462) || chr(127463) || chr(27) || '[0m' AS three,
        chr(27) || '[32m' || chr(19968) || chr(19969) || 'e' || chr(769) || chr(27) || '[0m' AS trimmed FROM l WHERE x IS NOT NULL
        UNION ALL SELECT doc_id, line_no, NULL, 2, 2, NULL, NULL, NULL FROM l WHERE x IS NULL""",
    "malformed_states": f"""WITH {LINES_SQL}, m AS (SELECT *, [{", ".join(f"'{v}'" for v in MALFORMED.values())}][line_no % {len(MALFORMED)} + 1] AS s FROM l),
        t AS (SELECT *, CASE WHEN s = '' THEN '' ELSE chr(27) || '[' || s || 'm' END AS state FROM m)
        SELECT doc_id, line_no, CASE WHEN x IS NOT NULL THEN state END AS state, CASE WHEN s = '' OR x IS NULL THEN '' ELSE chr(27) || '[0m' END AS close,
        CASE WHEN substring(x, 2, 4) = '' THEN '' WHEN s = '' THEN substring(x, 2, 4) ELSE state || substring(x, 2, 4) || chr(27) || '[0m' END AS part FROM t""",
    "output_blocks": f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<PRE class="term"><CODE>' || CASE WHEN text = '' THEN '' ELSE '<span style=''font-weight: bold;''>' || {_ESCAPED.format("text")} || '</span>' END
        || '</CODE></PRE>' ELSE text END AS shown FROM conversations""",
    "wrapped_documents": _WRAPPED + "SELECT doc_id, no, wrapped FROM w",
    "wrap_keeps_words": _WRAPPED + """SELECT doc_id, any_value(n)::BIGINT AS n_chars, max(length(line)) AS longest FROM w JOIN
        (SELECT doc_id, length(regexp_replace(coalesce(text, 'NA'), '[ \\t\\n]', '', 'g')) AS n FROM documents) USING (doc_id) GROUP BY doc_id""",
    "strsplit_colored": _sql(
        """CASE WHEN x = '' THEN '' WHEN NOT contains(x, ', ') THEN c ELSE array_to_string(list_transform(CASE WHEN x LIKE '%, ' THEN string_split(x, ', ')[:-2] ELSE string_split(x, ', ') END,
        lambda p: CASE WHEN p = '' THEN '' ELSE opened || p || chr(27) || '[0m' END), '|') END AS joined"""
    ),
    "close_state": _sql("chr(27) || '[0m' AS reset, chr(27) || '[22m' || chr(27) || '[39m' AS each"),
    "normalize_state": _sql(
        "CASE WHEN x = '' THEN '' ELSE replace(opened, ';48;5;', 'm' || chr(27) || '[48;5;') || x || chr(27) || '[39m' || chr(27) || '[49m' END AS part"
    ),
    "to_html_colored": _sql(
        f"""CASE WHEN x = '' THEN '' ELSE '<span style=''color: #' || CASE WHEN ((b - 16) // 18) % 2 = 1 THEN '000000' ELSE 'BBBBBB' END
        || '; background-color: #' || {PALETTE_SQL} || ';''>' || {_ESCAPED.format("x")} || '</span>' END AS html"""
    ),
    "html_esc": f"SELECT page_id, {_ESCAPED.format('html')} AS escaped FROM pages",
    "code_blocks": f"""SELECT conv_id, '<PRE class="term"><CODE>' || string_agg(coalesce({_ESCAPED.format("text")}, 'NA'), chr(10) ORDER BY turn) || '</CODE></PRE>' AS html
        FROM conversations GROUP BY conv_id""",
    "state_at_end_carried": f"""{OPEN_SQL} SELECT doc_id, line_no, CASE WHEN concat_ws(';', nullif(bold, ''), nullif(fg, '')) = '' THEN ''
        ELSE chr(27) || '[' || concat_ws(';', nullif(bold, ''), nullif(fg, '')) || 'm' END AS state FROM e""",
    "substr_carried": f"""{OPEN_SQL}, h AS (SELECT *, concat_ws(';', CASE WHEN s IS NOT NULL THEN s ELSE nullif(bold0, '') END, nullif(fg0, '')) AS st FROM e)
        SELECT doc_id, line_no, CASE WHEN substring(x, 1, 12) = '' THEN '' WHEN st = '' THEN substring(x, 1, 12)
        ELSE chr(27) || '[' || st || 'm' || substring(x, 1, 12) || chr(27) || '[0m' END AS part FROM h""",
    "to_html_carried": f"""{OPEN_SQL}, h AS (SELECT *, concat_ws('; ', 'color: #' || {_BASIC}[nullif(fg0, '')::INT - 29],
        CASE WHEN s IS NOT NULL OR bold0 = '1' THEN 'font-weight: bold' END) AS st FROM e)
        SELECT doc_id, line_no, CASE WHEN x = '' THEN '' WHEN st = '' THEN {_ESCAPED.format("x")}
        ELSE '<span style=''' || st || ';''>' || {_ESCAPED.format("x")} || '</span>' END AS html FROM h""",
    "unhandled_by_error": f"""WITH {LINES_SQL} SELECT CASE line_no % 4 WHEN 0 THEN 'non-SGR/hyperlink' WHEN 1 THEN 'exceed-term-cap' WHEN 2 THEN 'C0' ELSE 'invalid-substr' END AS error,
        count(*) AS n, sum(length(x) + 1)::BIGINT AS starts FROM l GROUP BY 1""",
}
