"""The format machine against the expressions and against slow loops; orders, carries and names in SQL text."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintline.functions.html import to_html
from tintline.functions.machine import NONE, Machine, Options, Positions, normalize_state, sizes
from tintline.functions.state import events, normalized, state_at_end
from tintline.functions.text import overlay_ctl, strsplit_ctl, strtrim_ctl, substr_ctl, trimws_ctl
from tintline.functions.width import LATER_WIDE, LATER_ZERO, widths
from tintline.operators.carry import stream_with_state, with_state
from tintline.operators.order import numbered, recycled
from tintline.operators.sql import functions_for_sql
from tintline.operators.tables import unhandled_ctl
from tintline.plans.more import BLANKS, QUERIES

E = "\x1b"
CODES = "0 1 2 3 4 7 9 20 21 22 23 24 31 92 39 44 104 49 38;5;7 48;2;1;2;3 38;5;300 38;7;4 11 51 53 55 61 65".split()
PIECES = ["a", "bc", " ", "一", "é", "\U0001f468‍\U0001f469", "\U0001f1e6\U0001f1e7", "\U0001f1e6", "é", "\n", "\x07", f"{E}[2J", f"{E}(", f"{E}]8;id=k;http://a.b{E}\\", f"{E}]8;;{E}\\"]


def texts(seed, n=60, pieces=PIECES):
    r = random.Random(seed)
    return ["".join(f"{E}[{';'.join(r.choices(CODES, k=r.randint(0, 3)))}m" if r.random() < 0.4 else r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(n)]


def test_machine_and_expressions_agree(spark):
    cases = texts(1, 120)
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, x string")
    found = frame.select("x", normalize_state(F.col("x")).alias("a"), normalized(F.col("x")).alias("b"), state_at_end(F.col("x")).alias("s"), events(F.col("x")).alias("e")).collect()
    known = Machine()
    for row in found:
        end = known.end(NONE, row.x)
        assert row.a == row.b, row.x
        assert known.opened(end) == row.s and [v or None for v in end] == [v or None for v in row.e]


def units(text, type):
    """(unit, room) one by one, controls apart, as a reader of the rules would do it."""
    table, out, flag, joined = widths(), [], False, False
    for c in text:
        cp = ord(c)
        if 0x1F1E6 <= cp <= 0x1F1FF:
            w, flag = (0, False) if flag else (2, True)
        else:
            w = 0 if 0x1F3FB <= cp <= 0x1F3FF or (joined and cp >= 0x80) else int(table[cp])
            flag = False
        joined = cp == 0x200D
        out.append(min(w, 1) if type == "graphemes" else w)
    return out


def test_sizes():
    r = random.Random(4)
    letters = "ab\n一é́‍\U0001f1e6\U0001f1e7\U0001f468\U0001f3fe♀"
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randrange(25)))
        for type in ("width", "graphemes"):
            assert sizes(text, type).tolist() == units(text, type), repr(text)
        many = Positions.all_of([text, None, "x", text], Options(type="width", ctl=("sgr",)))
        assert many[0].past.tolist() == many[3].past.tolist() == np.cumsum(units(text, "width")).tolist()


@pytest.mark.parametrize("round", ["start", "stop", "both", "neither"])
def test_cuts_by_width(round):
    """The visible part of a cut is what stands between the positions, with what has no width."""
    r = random.Random(9)
    known = Machine()
    for text in texts(2, 150, PIECES[:9]):
        for type in ("chars", "graphemes", "width"):
            p = Positions(text, Options(type, round))
            room, start = units(p.visible, type) if type != "chars" else [1] * len(p.visible), r.randint(-1, 8)
            stop, at, want = start + r.randint(-1, 9), 0, ""
            for c, w in zip(p.visible, room, strict=True):
                begins = at >= start - 1 if round in ("stop", "neither") else at + w > start - 1
                ends = at < stop if round in ("stop", "both") else at + w <= stop
                if w and begins and ends or not w and (want or start < 1):
                    want += c if w or at <= stop or want else ""
                elif w and want:
                    break
                at += w
            got = Positions(known.cut(p, start, stop), Options()).visible
            if stop >= max(start, 1):
                assert got == want, (text, type, start, stop)
            else:
                assert got == ""


def test_columns_of_the_machine(spark):
    frame = spark.createDataFrame([(1, f"{E}[31mab cd", 2), (2, "plain text", 3), (3, None, 1), (4, "", None), (5, "一丁七", 2), (6, f"a\t{E}[1mb", 1)], "k int, x string, n int").repartition(2)
    x, n = F.col("x"), F.col("n")
    found = {r.k: tuple(r)[1:] for r in frame.select("k", substr_ctl(x, n, n + 1).alias("a"), strtrim_ctl(x, 3).alias("b"), strsplit_ctl(x, F.when(n > 1, " ").otherwise("")).alias("c"), substr_ctl(x, 1, 4, "width", tab_stops=(4,)).alias("d"), to_html(x, carry=f"{E}[4m").alias("e")).collect()}
    assert found[1] == (f"{E}[31mb {E}[0m", f"{E}[31mab {E}[0m", [f"{E}[31mab{E}[0m", f"{E}[31mcd{E}[0m"], f"{E}[31mab c{E}[0m", "<span style='text-decoration: underline;'></span>".replace("><", ">|<").split("|")[0].replace("text-decoration: underline", "color: #BB0000; text-decoration: underline") + "ab cd</span>")
    assert found[2][:4] == ("ai", "pla", ["plain", "text"], "plai") and found[3] == (None,) * 5
    assert found[4] == (None, "", [], "", "") and found[5][:4] == ("丁七", "一", ["一丁七"], "一丁") and found[6][3] == "a   "
    # white space between matches, an expression of the library, and what can't be given to Python
    assert frame.filter("k = 2").select(strsplit_ctl(x, r"\s|(?<=x)").alias("c")).first().c == ["plain", "tex", "t"]
    with pytest.raises(ValueError, match="withColumn"):
        normalize_state(trimws_ctl(x))
    first = frame.withColumn("y", trimws_ctl(x)).select(normalize_state(F.col("y")).alias("z"), "k")
    assert {r.k: r.z for r in first.collect()}[1] == f"{E}[31mab cd"


def test_links_without_id_are_others():
    known, link = Machine(), f"{E}]8;;http://a.b{E}\\"
    assert known.normalized(f"{link}a{link}b{E}]8;;{E}\\") == f"{link}a{link}b{E}]8;;{E}\\"
    named = f"{E}]8;id=k;http://a.b{E}\\"
    assert known.normalized(f"{named}a{named}b") == f"{named}ab"


def test_overlay_by_loops(spark):
    """Plain texts: the native way and the machine's give what slicing gives."""
    r = random.Random(6)
    rows = [("".join(r.choice("abcdef") for _ in range(r.randrange(8))), "".join(r.choice("XYZ") for _ in range(r.randrange(5))), r.randint(-1, 7), r.randint(-1, 8)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "x string, v string, a int, b int")
    plain = overlay_ctl(F.col("x"), F.col("v"), F.col("a"), F.col("b"))
    forced = overlay_ctl(F.col("x"), F.col("v"), F.col("a"), F.col("b"), carry="")
    for row in frame.select("*", plain.alias("p"), forced.alias("q")).collect():
        begin, room = max(row.a, 1), min(row.b, len(row.x)) - max(row.a, 1) + 1
        n = min(room, len(row.v))
        changed = room >= 1 and row.b >= row.a and n >= 1
        lead = row.x[: begin - 1]
        assert row.p == (lead + row.v[:n] + row.x[begin - 1 + n :] if changed else row.x), row
        assert row.q == row.p, row


def test_long_white_space(spark):
    """A million blanks at either end and inside neither overflow the stack nor take long."""
    gap, began = " " * 1_000_000, time.time()
    cases = [f"{gap}{E}[1m{gap}x{gap}y{E}[0m{gap}", f"{E}[1m{gap}", f"x{gap}{E}[31m\t\n"]
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, x string").coalesce(1)
    found = [r[0] for r in frame.select(trimws_ctl(F.col("x"))).collect()]
    assert found == [f"{E}[1mx{gap}y{E}[0m", f"{E}[1m", f"x{E}[31m"] and time.time() - began < 60
    right = [r[0] for r in frame.select(trimws_ctl(F.col("x"), "right")).collect()]
    assert right[0] == f"{gap}{E}[1m{gap}x{gap}y{E}[0m"


def test_long_runs_are_not_gone_over(spark, tmp_path):
    """No regular expression goes over a text with thousands of blanks, and no function of arrays takes its formats apart."""
    spark.createDataFrame([(1, "en", " a b\n\nc "), (2, "en", None)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["trimws_long_runs"](spark, str(tmp_path))
    gap = " " * BLANKS
    assert [r.part for r in found.orderBy("doc_id", "line_no").collect()] == [f"{E}[1ma b{gap}z{E}[0m", f"{E}[1mz{E}[0m", f"{E}[1mc {gap}z{E}[0m", None]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in ("regexp", "aggregate(", "zip_with(") if f in plan]


def test_trimmed_ends(spark):
    """Links, broken sequences and texts of nothing but ends, on each side."""
    link = f"{E}]8;;http://a.com"
    cases = [f" {E}[1m {link}{E}\\ x {link}{E}\\ ", f"x {link}  ", f"{E}[1m {E}[4m\n", f" \t{E}[31 x{E}[5k {E}[m\r", f"x{E}]8;a{E}[1m {E}[4m", f"\u00a0{E}[32m\u00e9 \U0001f600{E}[39m ", "\t x\n", "", None]
    both, left, right = zip(*[tuple(r)[1:] for r in spark.createDataFrame(list(enumerate(cases)), "k int, x string").coalesce(1).select("k", *[trimws_ctl(F.col("x"), w).alias(w) for w in ("both", "left", "right")]).orderBy("k").collect()], strict=True)
    assert both == (f"{E}[1m{link}{E}\\x", f"x{link}  {E}\\", f"{E}[1;4m", f"{E}[31 x{E}[5k", f"x{E}]8;a{E}[1;4m", f"\u00a0{E}[32m\u00e9 \U0001f600{E}[0m", "x", "", None)
    assert left == (f"{E}[1m{link}{E}\\x {link}{E}\\ ", f"x {link}  ", f"{E}[1;4m", f"{E}[31 x{E}[5k {E}[m\r", *cases[4:6], "x\n", "", None)
    assert right == (f" {E}[1m {link}{E}\\ x", f"x{link}  {E}\\", f"{E}[1;4m", f" \t{E}[31 x{E}[5k", *both[4:6], "\t x", "", None)
    broken = spark.createDataFrame([(bytearray(b" \xff\x1b[1m\xfe  \x1b[22m "),)], "x binary").select(trimws_ctl(F.col("x").cast("string")).cast("binary").alias("y")).first().y
    assert bytes(broken) == b"\xff\x1b[1m\xfe\x1b[0m"


def test_widths():
    table = widths()
    assert [sum(b - a + 1 for a, b in ranges) for ranges in (LATER_ZERO, LATER_WIDE)] == [75, 355]
    for cp, w in {0x41: 1, 0xAD: 1, 0x300: 0, 0x4E00: 2, 0x1171E: 1, 0x1AE0: 0, 0x2630: 2, 0x1F6D8: 2, 0x18D80: 2, 0x11F5A: 0, 0x3FFFD: 2, 0x10FFFF: 1, 0x200B: 0, 0x1160: 0, 0x1F1E6: 1}.items():
        assert table[cp] == w, hex(cp)


def test_unhandled_positions_and_many(spark):
    bad = spark.createDataFrame([(1, f"一丁{E}[22>mz{E}[5k"), (2, f"{E}[22>m" * 100_000), (3, None), (4, "a\nb\x07")], "k int, x string")
    began = time.time()
    found = unhandled_ctl(bad, "x").filter("k <> 2").orderBy("k", "start").collect()
    assert [(r.k, r.start, r.stop, r.error) for r in found] == [(1, 5, 10, "invalid-substr"), (1, 12, 15, "non-SGR/hyperlink"), (4, 4, 4, "C0")]
    assert unhandled_ctl(bad.filter("k = 2"), "x").agg(F.max("stop")).first()[0] == 600_000 and time.time() - began < 60


def test_names_in_sql(spark):
    assert {"strip_ctl", "unhandled_ctl", "to_html"} <= set(functions_for_sql(spark))
    spark.createDataFrame([(1, f"<{E}[31ma{E}[0m>"), (2, None)], "k int, x string").createOrReplaceTempView("said")
    query = spark.sql("SELECT k, strip_ctl(x) AS s, has_ctl(x) AS h, nchar_ctl(x) AS n, nzchar_ctl(x) AS z, html_esc(strip_sgr(x)) AS e FROM said ORDER BY k")
    assert [tuple(r) for r in query.collect()] == [(1, "<a>", True, 3, True, "&lt;a&gt;"), (2, None, None, None, True, None)]
    assert "Python" not in query._jdf.queryExecution().toString()
    assert spark.sql("SELECT to_html(x) AS h, substr_width(x, 1, 2) AS w FROM said WHERE k = 1").first() == ("<<span style='color: #BB0000;'>a</span>>", f"<{E}[31ma{E}[0m")
    assert spark.sql("SELECT k, u.error FROM said, LATERAL unhandled_ctl(concat(x, chr(7))) AS u").collect() == [(1, "C0")]


def numbered_rows():
    r = random.Random(3)
    return [(k % 3 or None, k, f"{E}[{r.choice(CODES)}mx{k}" if r.random() < 0.3 else None if r.random() < 0.02 else f"plain {k}") for k in range(2000)]


@pytest.mark.parametrize("by", [["d"], []])
def test_carry_from_range_to_range(spark, by):
    frame = spark.createDataFrame(numbered_rows(), "d int, n int, x string").repartition(5)
    one = {r.n: r.state_in for r in with_state(frame, "x", by, ["n"], f"{E}[4m").collect()}
    dealt = with_state(frame, "x", by, ["n"], f"{E}[4m", parts=7)
    many = dealt.collect()
    assert len(many) == 2000 and {r.n: r.state_in for r in many} == one
    assert with_state(frame.limit(0), "x", by, ["n"], parts=3).count() == 0


def test_numbers_without_one_task(spark):
    frame = spark.createDataFrame(numbered_rows(), "d int, n int, x string").repartition(5)
    rows = numbered(frame, ["n"], parts=6)
    assert sorted((r.n, r.row_no) for r in rows.select("n", "row_no").collect()) == [(k, k + 1) for k in range(2000)]
    assert [r.v for r in rows.select("n", recycled(F.col("row_no"), [1, 3, 5]).alias("v")).orderBy("n").limit(4).collect()] == [1, 3, 5, 1]
    assert numbered(frame.limit(0), ["n"]).count() == 0
    with pytest.raises(ValueError):
        recycled(F.col("n"), [])


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, source = "d int, n int, x string", str(tmp_path / "in")
    os.makedirs(source)
    batches = [[(1, 2, f"b{E}[1mb"), (1, 1, f"{E}[31ma"), (2, 1, f"{E}[4mz")], [(1, 4, "d"), (1, 3, f"c{E}[0m"), (2, 2, None), (2, 3, "q")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        lines = stream_with_state(spark.readStream.schema(schema).json(source), "x", "d", "n")
        out = lines.select("d", "n", substr_ctl(F.col("x"), 1, 9, carry=F.col("state_in")).alias("s"))
        job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        job.awaitTermination(120)
        job.stop()
    whole = spark.createDataFrame(sum(batches, []), schema)
    want = with_state(whole, "x", ["d"], ["n"]).select("d", "n", substr_ctl(F.col("x"), 1, 9, carry=F.col("state_in")).alias("s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
