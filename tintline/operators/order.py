"""Rows in an order, without one task that holds them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that number a partition's rows.
_WITHIN = 33


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared folder for checkpoints, so that its partitions stay what they are.

    Only a local session without that folder (tests, one machine) gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tintline-"))
    return df.checkpoint()


def in_ranges(df: DataFrame, order_by: list[str], parts: int | None = None, into: str = "_id") -> DataFrame:
    """Rows dealt to ranges of ``order_by`` and sorted there, with a number that ascends in that order.

    The number's upper bits are those of the range. Rows that are equal in ``order_by`` are ordered as they come.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    return frozen(dealt.withColumn(into, F.monotonically_increasing_id()))


def range_of(number: Column) -> Column:
    return F.shiftright(number, _WITHIN)


def numbered(df: DataFrame, order_by: list[str], into: str = "row_no", parts: int | None = None) -> DataFrame:
    """Add the rows' numbers, from 1, in the order of the columns ``order_by``; nulls come first.

    Ranges are counted, and a range's rows go on from the counts before it, so the one small window
    is over a row for each range. Rows that are equal in ``order_by`` are numbered in any order.
    """
    rows = in_ranges(df, order_by, parts)
    counts = rows.groupBy(range_of(F.col("_id")).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_id").bitwiseAND((1 << _WITHIN) - 1)
    placed = rows.withColumn("_range", range_of(F.col("_id"))).join(F.broadcast(starts), "_range")  # a row for each range
    return placed.withColumn(into, F.col("_start") + within + 1).select(*df.columns, into)


def recycled(number: Column, values: list) -> Column:
    """The values over and over again, by a row's number from 1."""
    if not values:
        raise ValueError("values: one or more are asked for")
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((number - 1) % len(values)).cast("int") + 1)
