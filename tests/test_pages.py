"""Pages that are written whole or not at all, blocks of groups of any size, and wrapping in SQL text."""

import pytest
from pyspark.sql import functions as F

from tintline.functions.text import strwrap_ctl
from tintline.operators.sql import functions_for_sql
from tintline.operators.tables import code_block_parts, code_blocks
from tintline.sources.text import write_page


def page(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.iterdir()))


def beside(folder):
    return sorted(p.name for p in folder.parent.iterdir())


def test_page_is_whole_and_the_same_again(spark, tmp_path):
    blocks = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.concat(F.lit("line "), F.col("id")).alias("html")).repartition(5)
    out = tmp_path / "page"
    write_page(blocks, "html", "k", str(out), css=(".a {}",))
    first = page(out)
    lines = first.decode().splitlines()
    assert lines[:7] == ["<!DOCTYPE html>", "<html>", "<style>", ".a {}", "</style>", "<body>", "<pre>"] and lines[-3:] == ["</pre>", "</body>", "</html>"]
    assert lines[7:-3] == [f"line {i}" for i in sorted(range(5000), key=lambda i: (i % 1000, f"line {i}"))]
    assert all(p.name.startswith("part-") for p in out.iterdir())
    write_page(blocks.repartition(3), "html", ["k"], str(out), css=(".a {}",))
    assert page(out) == first and beside(out) == ["page"]
    with pytest.raises(Exception, match="is there already"):
        write_page(blocks, "html", "k", str(out), overwrite=False)


def test_a_failed_task_leaves_the_page_before(spark, tmp_path):
    good = spark.createDataFrame([(2, "b"), (1, "a"), (None, None)], "k int, html string")
    bad = spark.range(1000).select("id", F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("html"))
    out = tmp_path / "page"
    with pytest.raises(Exception, match="lost"):
        write_page(bad, "html", "id", str(out))
    assert beside(out) == []
    write_page(good, "html", "k", str(out), pre=False)
    before = page(out)
    assert before.decode().splitlines() == ["<!DOCTYPE html>", "<html>", "<body>", "", "a", "b", "</body>", "</html>"]

    def dies_on_the_way(batches):
        for n, batch in enumerate(batches):
            yield batch
            if n == 2:
                raise RuntimeError("lost on the way")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        # after some batches of the part are written
        lines = spark.range(1000, numPartitions=2).select(F.col("id").cast("string").alias("value")).mapInArrow(dies_on_the_way, "value string")
        with pytest.raises(Exception, match="lost on the way"):
            lines.write.format("page").mode("overwrite").save(str(out))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert page(out) == before and beside(out) == ["page"]


def test_an_empty_page(spark, tmp_path):
    write_page(spark.createDataFrame([], "k int, html string"), "html", "k", str(tmp_path / "page"))
    assert page(tmp_path / "page").decode().split() == ["<!DOCTYPE", "html>", "<html>", "<body>", "<pre>", "</pre>", "</body>", "</html>"]


def test_blocks_in_parts(spark):
    """A third of the rows is one group; null groups, null texts and equal groups in a row."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"g{i % 7}", i, None if i % 11 == 0 else f"t{i}") for i in range(2000)]
    turns = spark.createDataFrame(rows, "g string, n int, x string").repartition(6)
    whole = {r.g: r.html for r in code_blocks(turns, "x", ["g"], "n").collect()}
    parts = code_block_parts(turns, "x", ["g"], ["n"], rows=64).collect()
    found = {}
    for r in sorted(parts, key=lambda r: r.part_no):
        found[r.g] = found.get(r.g, "") + r.html
    assert found == whole and max(r.html.count("\n") for r in parts) <= 64
    for g in whole:
        numbers = sorted(r.part_no for r in parts if r.g == g)
        assert numbers == list(range(1, len(numbers) + 1))
    assert code_block_parts(turns.limit(0), "x", ["g"], ["n"]).count() == 0


def test_wrap_in_sql_text(spark):
    assert "strwrap_ctl" in functions_for_sql(spark)
    texts = ["hello world, this is a day", "\x1b[1mhello wide \u4e00\u4e01 world\x1b[0m", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    frame.createOrReplaceTempView("wrap_in_sql")
    found = spark.sql("SELECT x, strwrap_ctl(x, 12) AS w, strwrap_ctl(x, CAST(NULL AS INT)) AS none FROM wrap_in_sql").collect()
    assert {(r.x, tuple(r.w)) for r in found} == {(r.x, tuple(r.w)) for r in frame.select("x", strwrap_ctl(F.col("x"), 12).alias("w")).collect()}
    assert all(r.none is None for r in found)
