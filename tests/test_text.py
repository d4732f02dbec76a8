"""Functions on text with control sequences: known answers, and properties against plain text."""

import random
import textwrap
import unicodedata

import pytest
from pyspark.sql import functions as F

from tintline.functions import aliases
from tintline.functions.controls import has_ctl, has_sgr, nchar_ctl, nchar_sgr, nzchar_ctl, nzchar_sgr, strip_ctl, strip_sgr
from tintline.functions.demo import color_lines, default_css, default_term_cap, palette_chart, print_text, term_cap_test, unicode_version
from tintline.functions.html import html_esc, make_styles, output_block, to_html
from tintline.functions.machine import Machine, Options, Positions, normalize_state, sizes
from tintline.functions.state import bridge, close_state, events, normalized, state_at_end
from tintline.functions.text import overlay_ctl, squeeze_space, strsplit_ctl, strtrim_ctl, strwrap_ctl, substr_ctl, tabs_as_spaces, trimws_ctl
from tintline.operators.carry import carried
from tintline.operators.tables import code_blocks, exploded, lines, unhandled_ctl
from tintline.plans.catalogue import QUERIES
from tintline.sources.text import read_documents, write_page

E = "\x1b"


def each(spark, values, *functions):
    """For each value the results of the functions, in one query."""
    frame = spark.createDataFrame(list(enumerate(values)), "k int, x string").coalesce(1)
    found = frame.select("k", *[f(F.col("x")).alias(f"r{n}") for n, f in enumerate(functions)]).orderBy("k").collect()
    rows = [tuple(r)[1:] for r in found]
    return [r[0] for r in rows] if len(functions) == 1 else rows


MIXED = f"hello{E}k{E}[45p world\n{E}[31mgoodbye\a moon"


def test_controls(spark):
    assert each(spark, [MIXED], strip_ctl) == ["hello worldgoodbye moon"]
    found = each(
        spark, [MIXED, "plain", "", None, f"{E}[31m123\a\r", f"{E}]8;;http://a.b{E}\\link{E}]8;;{E}\\"],
        has_ctl, has_sgr, lambda x: has_ctl(x, ()), nchar_ctl, lambda x: nchar_ctl(x, "width"), nzchar_ctl, lambda x: nzchar_ctl(x, keep_na=True), lambda x: nchar_ctl(x, "bytes"),
    )
    assert [r[0] for r in found] == [True, False, False, None, True, True]
    assert [r[1] for r in found] == [True, False, False, None, True, True]
    assert [r[2] for r in found] == [False] * 6
    assert [r[3] for r in found] == [23, 5, 0, None, 3, 4]
    assert [r[4] for r in found] == [23, 5, 0, 2, 3, 4]
    assert [r[5] for r in found] == [True, True, False, True, True, True]
    assert [r[6] for r in found] == [True, True, False, None, True, True]
    assert [r[7] for r in found] == [23, 5, 0, None, 3, 4]


def test_kinds(spark):
    x = f"a{E}[31mb{E}[2Jc\nd\te{E}]8;;u{E}\\f{E}]2;t\ag{E}(h"
    kept = each(spark, [x], *[lambda v, k=k: strip_ctl(v, k) for k in ("sgr", "csi", "nl", "c0", "url", "osc", ("all", "sgr"))], strip_sgr)[0]
    assert kept == (
        x.replace(f"{E}[31m", ""), x.replace(f"{E}[2J", ""), x.replace("\n", ""), kept[3],
        x.replace(f"{E}]8;;u{E}\\", ""), x.replace(f"{E}]2;t\a", ""), f"a{E}[31mbcdefgh", x.replace(f"{E}[31m", "").replace(f"{E}]8;;u{E}\\", ""),
    )
    with pytest.raises(ValueError):
        strip_ctl(F.lit("x"), "nope")


def test_width(spark):
    cases = {
        "plain": (5, 5), "一丁": (4, 2), "é": (1, 1), "\U0001f468": (2, 1), "\U0001f468\U0001f3fe": (2, 1),
        "\U0001f468\U0001f3fe‍\U0001f9b3": (2, 1), "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466": (2, 1), "\U0001f1e6\U0001f1e7": (2, 1), "\U0001f1e6": (2, 1), "\U0001f1e6\U0001f1e7\U0001f1e6": (4, 2), "a­b": (3, 3), "": (0, 0),
    }
    found = each(spark, list(cases), lambda x: nchar_ctl(x, "width"), lambda x: nchar_ctl(x, "graphemes"))
    assert dict(zip(cases, found, strict=True)) == cases


def test_states(spark):
    assert each(spark, [f"hello{E}[42;33m world{E}[m", "plain", None], normalize_state) == [f"hello{E}[33m{E}[42m world{E}[39m{E}[49m", "plain", None]
    cases = [f"{E}[44mhello", f"{E}[33;44mworld", f"{E}[1;2;22;31mx{E}[0my", f"{E}[38;2;1;2;3mx", f"{E}[38;5;300mx", "", None]
    found = each(spark, cases, state_at_end, lambda x: close_state(x, True), close_state)
    assert found[0] == (f"{E}[44m", f"{E}[49m", f"{E}[0m")
    assert found[1] == (f"{E}[33;44m", f"{E}[39m{E}[49m", f"{E}[0m")
    assert found[2] == ("", "", "")
    assert found[3][0] == f"{E}[38;2;1;2;3m"
    assert found[4] == ("", "", "")
    assert found[5] == ("", "", "") and found[6] == (None, "", "")
    link = f"{E}]8;id=a;http://x.y{E}\\"
    assert each(spark, [f"{link}z"], state_at_end, close_state) == [(link, f"{E}]8;;{E}\\")]


def test_colours_with_wrong_parameters(spark):
    """A selector takes its parameters with it, right or wrong; another selector is a code of its own."""
    cases = {"38;5;300": "", "38;5": "", "38": "", "48;2;1;2;999": "", "48;2;1;2": "", "38;5;300;1": "1", "48;2;999;1;1;3": "3", "38;7;1": "1;7", "38;7": "",
             "38;5;;4": "4;38;5;0", "038;05;007": "38;5;7", "38;2;1;2;3;9": "9;38;2;1;2;3", "38;999;1": "1", "38;1!;4": "4", "1;;4": "4", "9999;1": "1", "38;5;1!": ""}
    assert dict(zip(cases, each(spark, [f"{E}[{c}mx" for c in cases], state_at_end), strict=True)) == {c: f"{E}[{v}m" if v else "" for c, v in cases.items()}
    old = lambda x: state_at_end(x, term_cap=("256", "old"))
    found = each(spark, [f"{E}[91;1mx", f"{E}[38;2;1;4;9mx", f"{E}[38;5;9mx"], old, lambda x: state_at_end(x, term_cap=("bright",)))
    assert found == [(f"{E}[1m", f"{E}[1;91m"), (f"{E}[1;2;4;9m", f"{E}[38;2;1;4;9m"), (f"{E}[38;5;9m", f"{E}[38;5;9m")]
    with pytest.raises(ValueError):
        state_at_end(F.lit("x"), term_cap=("nope",))


def test_normalize_twice(spark):
    r = random.Random(13)
    codes = "0 1 2 3 4 7 9 20 21 22 24 31 92 39 44 38;5;7 48;2;1;2;3 38;5;300 51 54".split()
    texts = ["".join(f"{E}[{';'.join(r.choices(codes, k=r.randint(0, 3)))}m{'x' * r.randint(0, 2)}" for _ in range(r.choice([3, 70, 200]))) for _ in range(12)]
    found = each(spark, texts, normalize_state, lambda x: normalize_state(normalize_state(x)), state_at_end, lambda x: state_at_end(normalize_state(x)), lambda x: strip_ctl(normalize_state(x)), strip_ctl)
    for once, twice, end, end_once, text, stripped in found:
        assert once == twice and end == end_once and text == stripped


@pytest.mark.parametrize("normalize", [False, True])
def test_bridge(spark, normalize):
    """Whatever the states, what stands behind the bridge is the second."""
    r = random.Random(3)
    codes = "0 1 2 3 4 7 9 20 21 22 23 24 31 92 39 44 104 49 38;5;7 48;2;1;2;3 11 51 53 55 61 65".split()
    pairs = [tuple(f"{E}[{';'.join(r.choices(codes, k=r.randint(0, 4)))}mx" for _ in range(2)) for _ in range(60)]
    frame = spark.createDataFrame(pairs, "a string, b string").select("b", F.concat("a", bridge(events(F.col("a")), events(F.col("b")), normalize)).alias("c"), "a")
    for row in frame.select(state_at_end(F.col("b")).alias("b"), state_at_end(F.col("c")).alias("c"), "a").collect():
        assert row.b == row.c, row


def test_substr(spark):
    x = f"{E}[42mhello{E}[m world"
    cuts = [(1, 9), (3, 9), (0, 5), (-2, 0), (4, 3), (6, 100), (50, 60)]
    found = each(spark, [x, "hello world", None], *[lambda v, c=c: substr_ctl(v, *c) for c in cuts])
    assert found[0] == (f"{E}[42mhello{E}[m wor", f"{E}[42mllo{E}[m wor", f"{E}[42mhello{E}[0m", "", "", " world", "")
    assert found[1] == ("hello wor", "llo wor", "hello", "", "", " world", "")
    assert found[2] == (None,) * len(cuts)
    # positions as columns go another way, with the same result
    other = each(spark, [x, "hello world"], *[lambda v, c=c: substr_ctl(v, F.lit(c[0]), F.lit(c[1])) for c in cuts])
    assert other == found[:2]
    wide = each(spark, [f"{E}[31m一丁七"], *[lambda v, r=r: substr_ctl(v, 2, 3, "width", r) for r in ("start", "stop", "both", "neither")])[0]
    assert [w.replace(f"{E}[31m", "").replace(f"{E}[0m", "") for w in wide] == ["一", "丁", "一丁", ""]
    long = "x" * 200_000
    assert [len(v) for v in each(spark, [long, f"{E}[1m{long}"], lambda v: substr_ctl(v, 10, 150_000))] == [149_991, 149_999]


def test_overlay_and_trims(spark):
    assert each(spark, ["abcdef", "ab", None], lambda x: overlay_ctl(x, F.lit("XYZ"), 2, 3)) == ["aXYdef", "aX", None]
    assert each(spark, [f" {E}[31m\thello world\t{E}[39m  ", "  x ", " ", None], trimws_ctl)[:2] == [f"{E}[31mhello world{E}[0m", "x"]
    assert each(spark, [f"{E}[31mhello world", "一丁七", None], lambda x: strtrim_ctl(x, 5)) == [f"{E}[31mhello{E}[0m", "一丁", None]
    assert each(spark, ["1\t12\t123", f"a{E}[31m\tb", "x\n\ty", None], tabs_as_spaces) == ["1       12      123", f"a{E}[31m       b", "x\n        y", None]


def test_overlay_options(spark):
    red = f"{E}[31mabcdef"
    mark = F.lit(f"{E}[1mXY")
    assert each(spark, [red], lambda x: overlay_ctl(x, mark, 2, 3), lambda x: overlay_ctl(x, mark, 2, 3, normalize=True), lambda x: overlay_ctl(x, mark, 2, 3, terminate=False)) == [
        (f"{E}[31ma{E}[0m{E}[1mXY{E}[0m{E}[31mdef", f"{E}[31ma{E}[39m{E}[1mXY{E}[22m{E}[31mdef", f"{E}[31ma{E}[1mXYdef"),
    ]
    assert each(spark, ["abc"], lambda x: overlay_ctl(x, F.lit("Z"), 2, 2, carry=f"{E}[4m")) == [f"a{E}[0mZ{E}[4mc"]  # what goes before has left the terminal in that state
    assert each(spark, ["a\tb"], lambda x: overlay_ctl(x, F.lit("ZZ"), 2, 3, tab_stops=(4,))) == ["aZZ b"]
    # a wide character has no room in one column, and two columns' room for one of two
    assert each(spark, ["abcdef"], *[lambda x, r=r: overlay_ctl(x, F.lit("一丁"), 2, 4, "width", r) for r in ("start", "stop", "both", "neither")]) == [("a一def", "a一def", "a一def", "a一def")]
    assert each(spark, ["abc"], lambda x: overlay_ctl(x, F.lit("一"), 2, 2, "width"), lambda x: overlay_ctl(x, F.lit("Z"), 9, 9), lambda x: overlay_ctl(x, F.lit(None).cast("string"), 1, 1)) == [("abc", "abc", None)]


def test_nchar_invalid(spark):
    frame = spark.createDataFrame([(b"ab\xff",), (b"abc",)], "b binary").select(F.col("b").cast("string").alias("x"))
    assert [r[0] for r in frame.select(nchar_ctl(F.col("x"), allow_na=True)).collect()] == [None, 3]
    with pytest.raises(Exception, match="valid UTF-8"):
        frame.select(nchar_ctl(F.col("x"), allow_na=False)).collect()


def test_split(spark):
    texts = ["a,b,,c,", ",a", "", None, "abc", "a, b"]
    assert each(spark, texts, lambda x: strsplit_ctl(x, ",")) == [["a", "b", "", "c"], ["", "a"], [], None, ["abc"], ["a", " b"]]
    assert each(spark, [f"a{E}[31mb"], lambda x: strsplit_ctl(x, "")) == [["a", f"{E}[31mb{E}[0m"]]
    red = f"{E}[31mone two{E}[0m three"
    assert each(spark, [red], lambda x: strsplit_ctl(x, " ")) == [[f"{E}[31mone{E}[0m", f"{E}[31mtwo{E}[0m", "three"]]
    # a control within a match, and a match that takes controls
    assert each(spark, [f"a,{E}[1m,b"], lambda x: strsplit_ctl(x, ",,", fixed=True)) == [["a", f"{E}[1mb{E}[0m"]]
    assert each(spark, [f"a{E}[1mb1c"], lambda x: strsplit_ctl(x, "[^a-z]+")) == [[f"a{E}[1mb{E}[0m", f"{E}[1mc{E}[0m"]]


def test_wrap(spark):
    text = "hello world this is a lovely day"
    colored = f"{E}[34mhello world{E}[0m this is a lovely day"
    found = each(spark, [text, colored, "", None], lambda x: strwrap_ctl(x, 10))
    assert found[0] == ["hello", "world", "this is a", "lovely", "day"]
    assert found[1] == [f"{E}[34mhello{E}[0m", f"{E}[34mworld{E}[0m", *found[0][2:]]
    assert found[2:] == [[""], ["NA"]]
    r = random.Random(5)
    plain = [" ".join("x" * r.randint(1, 9) for _ in range(40)) for _ in range(5)]
    assert each(spark, plain, lambda x: strwrap_ctl(x, 31)) == [textwrap.wrap(p, 30) for p in plain]
    assert each(spark, ["abcdefghij kl"], lambda x: strwrap_ctl(x, 5, wrap_always=True, pad_end=".")) == [["abcd", "efgh", "ij..", "kl.."]]
    assert each(spark, ["a  b\nc"], lambda x: strwrap_ctl(x, 20, strip_spaces=False)) == [["a  b", "c"]]
    assert each(spark, ["a b"], lambda x: strwrap_ctl(x, 20, prefix="> ", indent=1)) == [[">  a b"]]


def test_wrap_colored_is_wrap_of_plain(spark):
    """Stripped lines of a coloured text are the lines of the stripped text, whatever stands between its words."""
    r = random.Random(7)
    gaps, words = [" ", "  ", "\n", "\n\n", " \t ", f" {E}[31m", f"{E}[0m ", f" {E}[1m {E}[4m {E}[0m ", f"{E}[2m"], ["a", "bcd.", "efghi", "(j!)", "klmnopqrst", "uvw?\"", "一丁", "e\u0301x"]
    texts = ["".join(r.choice(words[: 6 if k % 2 else 8]) + r.choice(gaps) for _ in range(r.randint(0, 60))) for k in range(40)]
    found = each(spark, texts, *[lambda x, w=w: F.transform(strwrap_ctl(x, w), lambda t: strip_ctl(t)) for w in (6, 20)], *[lambda x, w=w: strwrap_ctl(strip_ctl(x, ("all", "nl")), w) for w in (6, 20)])
    for text, row in zip(texts, found, strict=True):
        assert row[0] == row[2] and row[1] == row[3], text
    sized = each(spark, texts, lambda x: F.transform(strwrap_ctl(x, 20), lambda t: F.struct(strip_ctl(t).alias("t"), nchar_ctl(t, "width").alias("w"))))
    assert all(line.w <= 19 or " " not in line.t for row in sized for line in row)


def test_wrap_options_with_formats(spark):
    red, bold = f"{E}[31m", f"{E}[1m"
    # words are broken between characters, by width, and never within a sequence
    assert each(spark, [f"abc{red}defgh{E}[0m ij", "一二三四 x"], lambda x: strwrap_ctl(x, 6, wrap_always=True)) == [
        [f"abc{red}de{E}[0m", f"{red}fgh{E}[0m", "ij"], ["一二", "三四", "x"]]
    assert each(spark, [f"{bold}一 b"], lambda x: strwrap_ctl(x, 4, pad_end="."), lambda x: strwrap_ctl(x, 4, terminate=False)) == [
        ([f"{bold}一.{E}[0m", f"{bold}b..{E}[0m"], [f"{bold}一", f"{bold}b"])]
    assert each(spark, [f" a{bold}  b\nc"], lambda x: strwrap_ctl(x, 20, strip_spaces=False)) == [[f" a{bold}  b{E}[0m", f"{bold}c{E}[0m"]]
    assert each(spark, ["a\tb"], lambda x: strwrap_ctl(x, 20, tab_stops=(4,), strip_spaces=False)) == [["a   b"]]
    assert each(spark, [bold, f"a {bold}", f"{bold}{red}a{E}[22;31mb"], lambda x: strwrap_ctl(x, 9), lambda x: strwrap_ctl(x, 9, normalize=True)) == [
        ([""], [""]), (["a"], ["a"]), ([f"{E}[1;31ma{E}[22;31mb{E}[0m"], [f"{bold}{red}a{E}[22mb{E}[39m"])]
    # formats around prefix and padding; empty lines without indent, and without a format unless they are filled up
    boxed = f"{red}a b\n\nc"
    assert each(spark, [boxed, ""], lambda x: strwrap_ctl(x, 6, prefix="> ", indent=1, pad_end="."), lambda x: strwrap_ctl(x, 9, prefix="> ", indent=1, strip_spaces=False)) == [
        ([f"{red}>  a.{E}[0m", f"{red}> b..{E}[0m", f"{red}>  c.{E}[0m"], [f"{red}>  a b{E}[0m", "> ", f"{red}>  c{E}[0m"]), (["> .."], ["> "])]
    carried = each(spark, ["a b", ""], lambda x: strwrap_ctl(x, 2, carry=red))
    assert carried == [[f"{red}a{E}[0m", f"{red}b{E}[0m"], [""]]


def test_wrap_plain_and_by_machine_agree(spark):
    """What Catalyst fills, the machine fills alike."""
    from tintline.functions.machine import machine
    from tintline.functions.wrap import Wrapping, wrapped

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "bc.", "defg", "(hij!)", "x" * 25]) + r.choice([" ", "  ", "\n", "\n\n", " \t", "   "]) for _ in range(r.randint(0, 50))) for _ in range(60)]
    for width, head, rest in ((2, "", ""), (9, "", ""), (24, "* ", "  "), (24, "", "    ")):
        quick = each(spark, texts, lambda x: strwrap_ctl(x, width, initial=head, prefix=rest, pad_end="."))
        assert quick == [wrapped(machine(None), t, Wrapping(width - 1, head, rest, 0, 0, pad_end=".")) for t in texts]


def test_wrap_white_space(spark):
    bar = "a" + "".join(f" {E}[4{k % 8}m" for k in range(12)) + " b"
    assert each(spark, [bar, "a\ufdd0b c\ufdd1d", "one.  Two   three.\nFour", "\n\n x \n \n y\n\n"], lambda x: strip_ctl(squeeze_space(x), ("all", "nl"))) == [
        "a b", "a\ufdd0b c\ufdd1d", "one.  Two three. Four", "x\n\ny"]
    assert each(spark, ["aa bb cc dd"], lambda x: strwrap_ctl(x, 9, prefix="> ", exdent=2), lambda x: strwrap_ctl(x, 3)) == [(["> aa bb", ">   cc", ">   dd"], ["aa", "bb", "cc", "dd"])]
    long = " ".join(["word"] * 40_000)
    assert each(spark, [long, f"{E}[1m{long}"], lambda x: F.size(strwrap_ctl(x, 61))) == [3334, 3334]


def test_split_and_trim_carry(spark):
    bold = f"{E}[1m"
    assert each(spark, ["a b"], lambda x: strsplit_ctl(x, " ", carry=bold)) == [[f"{E}[1ma{E}[0m", f"{E}[1mb{E}[0m"]]
    assert each(spark, [f" {E}[31m a"], lambda x: trimws_ctl(x, ctl="url"), lambda x: trimws_ctl(x)) == [(f"{E}[31m a", f"{E}[31ma")]


def test_split_carries_into_texts_without_a_match(spark, tmp_path):
    bold, red = f"{E}[1m", f"{E}[31mab{E}[39m"
    found = each(spark, ["ab", "", None, red, "a b", "a "], lambda x: strsplit_ctl(x, " ", carry=bold), lambda x: strsplit_ctl(x, " ", carry=""), lambda x: strsplit_ctl(x, " "))
    one = [f"{E}[1ma{E}[0m"]
    assert [r[0] for r in found] == [[f"{E}[1mab{E}[0m"], [], None, [f"{E}[1;31mab{E}[0m"], [*one, f"{E}[1mb{E}[0m"], one]
    assert [r[1] for r in found] == [r[2] for r in found] == [["ab"], [], None, [red], ["a", "b"], ["a"]]  # nothing is carried
    spark.createDataFrame([(1, "en", "no match\n\none, two\nend, "), (2, "en", None), (3, "en", "")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["strsplit_carried"](spark, str(tmp_path)).orderBy("doc_id", "line_no").collect()
    assert [r.joined for r in rows] == [f"{E}[1mno match{E}[0m", "", f"{E}[1mone{E}[0m|{E}[1mtwo{E}[0m", f"{E}[1mend{E}[0m", None, ""]


def test_output_block(spark):
    assert each(spark, [f"a<{E}[1mb", "a<b", None], lambda x: output_block(x, "k")) == [
        '<PRE class="k"><CODE>a&lt;<span style=\'font-weight: bold;\'>b</span></CODE></PRE>', "a<b", None]


def test_html(spark):
    x = f"hello{E}[31;42;1mworld{E}[m"
    assert each(spark, [x, "plain", None], to_html) == [
        "hello<span style='color: #BB0000; background-color: #00BB00; font-weight: bold;'>world</span>", "plain", None,
    ]
    day = each(spark, [f"{E}[43;34mday > night"], lambda v: to_html(html_esc(v)))[0]
    assert day == "<span style='color: #0000BB; background-color: #BBBB00;'>day &gt; night</span>"
    assert each(spark, ["<he&llo>'"], html_esc) == ["&lt;he&amp;llo&gt;&#039;"]
    assert "<a href='http://a.b'>" in each(spark, [f"{E}]8;;http://a.b{E}\\link{E}]8;;{E}\\"], to_html)[0]
    assert "class='term-color-001'" in each(spark, [f"{E}[31mx"], lambda v: to_html(v, classes=True))[0]
    assert make_styles(spark).count() == 512
    with pytest.raises(ValueError):
        html_esc(F.lit("x"), "q")


def test_carry_equals_one_text(spark):
    """The state that a line begins in is that at the end of all lines before it."""
    r = random.Random(11)
    docs = [[f"{E}[{r.choice(['31', '1', '0', '39', '44', '7;32', '22'])}m{'x' * r.randint(0, 3)}" if r.random() < 0.6 else "plain" for _ in range(12)] for _ in range(5)]
    rows = [(d, n, x, "".join(doc[: n + 1])) for d, doc in enumerate(docs) for n, x in enumerate(doc)]
    frame = spark.createDataFrame(rows, "d int, n int, x string, upto string").repartition(3)
    out = carried(frame, "x", ["d"], ["n"], "state", lambda c, s: state_at_end(c, carry=s))
    assert out.filter(F.col("state") != state_at_end(F.col("upto"))).count() == 0
    gone = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b")], "d int, n int, x string")
    assert [r.y for r in carried(gone, "x", ["d"], ["n"], "y", lambda c, s: substr_ctl(c, 1, 1, carry=s)).orderBy("n").collect()] == ["a", None, None]


def test_tables(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "k int, t string")
    assert sorted((r.k, r.line_no, r.line) for r in lines(frame, "t").collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, None), (3, 1, "")]
    assert exploded(frame.select("k", strsplit_ctl(F.col("t"), "\n", ctl=("all", "nl")).alias("p")), F.col("p")).count() == 2
    bad = spark.createDataFrame([(1, f"foo{E}[22>m"), (2, "fine"), (3, None), (4, f"ab{E}")], "k int, t string")
    assert [(r.k, r.start, r.stop, r.error) for r in unhandled_ctl(bad, "t").orderBy("k").collect()] == [(1, 4, 9, "invalid-substr"), (4, 3, 3, "malformed-ESC")]
    blocks = code_blocks(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "d int, n int, x string"), "x", ["d"], "n")
    assert blocks.first().html == '<PRE class="term"><CODE>a\nb</CODE></PRE>'
    write_page(blocks, "html", "d", str(tmp_path / "page"), css=(default_css(),))
    assert "<CODE>a" in "\n".join(r.text for r in read_documents(spark, str(tmp_path / "page" / "*.html")).collect())


def test_demo(spark, monkeypatch):
    assert each(spark, ["A", ""], lambda x: color_lines(x, F.lit(1))) == [f"{E}[37;48;5;18mA{E}[39;49m", ""]
    assert palette_chart(spark).count() > 20 and unicode_version() == "17.0.0" and len(term_cap_test()) == 3
    print_text(["x"])
    monkeypatch.setenv("COLORTERM", "truecolor")
    assert "truecolor" in default_term_cap()


def test_aliases(spark):
    x = f"a\t{E}[31mbc"
    found = each(spark, [x], lambda v: aliases.substr_sgr(v, 1, 3), lambda v: aliases.strtrim2_ctl(v, 9, tab_stops=(8,)), nchar_sgr, nzchar_sgr, lambda v: aliases.strsplit_sgr(v, "\t"), aliases.sgr_to_html)
    assert found[0][:5] == (f"a\t{E}[31mb{E}[0m", f"a       {E}[31mb{E}[0m", 4, True, ["a", f"{E}[31mbc{E}[0m"])


def test_streams(spark, tmp_path):
    """Functions of one row work on a stream as they are."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{E}[31mred{E}[0m\nplain\n")
    stream = spark.readStream.text(str(tmp_path / "in")).select(to_html(F.col("value")).alias("h"))
    job = stream.writeStream.format("memory").queryName("converted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted(r.h for r in spark.table("converted").collect()) == ["<span style='color: #BB0000;'>red</span>", "plain"]
