"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, checkpointed, lower_ascii


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _digest(key: Column) -> Column:
    """128 bits of a key: xxhash64 twice, with different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def line_dedup(
    docs: DataFrame, min_length: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop shared lines; returns doc_id, text, n_lines, n_dropped.

    A line's key is the line stripped of white space at both ends, with A-Z in
    lower case. Keys of at least ``min_length`` characters in at least
    ``min_docs`` documents lose all their lines but those of the largest doc_id
    that has the key; the other lines stay, in their order.

    Every row is a document of its own, also where ids repeat: a key counts once
    for each row, and all rows with the largest id keep it. A null id counts as
    smaller than any; if only null ids have a key, all keep it. A null or empty
    text is one empty line, and its text comes back empty. Other columns are not
    read.

    Lines travel as hash and position. Keys are taken once per document before the
    shuffle and counted with partial sums, so a line in a third of all rows is a few rows
    for each task. The join that finds the lines to drop has one small row per key on its
    other side; adaptive execution splits the large side where a key is hot. What is
    left of a text is put together from its lines by position, in steps that grow with
    its number of lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    # (pos, a, b) of each line whose key is long enough
    keyed_lines = F.filter(
        F.transform(lines, lambda x, k: F.struct(k.alias("pos"), F.when(F.length(x) >= min_length, line_key(x)).alias("key"))),
        lambda s: F.length(s["key"]) >= min_length,
    )
    marks = F.transform(keyed_lines, lambda s: F.struct(s["pos"].alias("pos"), _digest(s["key"]).alias("h")))
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t"), marks.alias("marks"))
    # rows that share an id are told apart by their texts
    rows = rows.withColumns({"d0": F.xxhash64("i", "t"), "d1": F.xxhash64(F.lit(7), F.col("i"), F.col("t"))})
    once = rows.select("i", F.explode(F.array_distinct(F.transform("marks", lambda m: m["h"]))).alias("h"))
    shared = once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("keeper")).filter(F.col("n") >= min_docs)
    shared = checkpointed(shared.select("h", "keeper"))
    loses = F.col("keeper").isNotNull() & (F.col("i").isNull() | (F.col("i") < F.col("keeper")))
    placed = rows.select("i", "d0", "d1", F.explode("marks").alias("m")).select("i", "d0", "d1", "m.pos", "m.h")
    drops = placed.join(shared, "h").filter(loses).groupBy("d0", "d1").agg(F.collect_set("pos").alias("drop"))
    joined = rows.select("i", "t", "d0", "d1").join(drops, ["d0", "d1"], "left")
    split = F.split("t", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop"))
    kept = F.element_at(F.transform(F.array(split), lambda x: F.transform(places, lambda k: F.get(x, k))), 1)
    return joined.select(
        F.col("i").alias(id_col),
        F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
