"""Format state carried from line to line of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.machine import NONE, machine
from ..functions.state import NAMES, events
from .order import in_ranges, range_of


#: Between the registers of a state as a text; no code or address has it.
_BETWEEN = "\x01"


def _over(rows: DataFrame, keys: list[str], order_by: list[str], initial: list[Column]) -> list[Column]:
    before = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.last(F.col("_events")[k], ignorenulls=True).over(before), initial[k]) for k in range(len(NAMES))]


def with_state(
    df: DataFrame, x: str, partition_by: list[str], order_by: list[str], initial: str = "", into: str = "state_in",
    term_cap: tuple[str, ...] | None = None, parts: int | None = None,
) -> DataFrame:
    """Add the state that each row's text begins in: that of its document's lines before it.

    A register's state is its last assignment in an earlier row, so one window with
    a last-value for each register carries all of them. ``initial`` is a text whose end
    the documents begin with.

    The lines of a document are sorted within one task. With ``parts`` they needn't be: rows are
    dealt to so many ranges of document and line, each range carries within itself, and what a
    document's ranges assign at last is carried from range to range, as one row for each.
    """
    start = [F.lit(v or None) for v in machine(term_cap).end(NONE, initial)]
    with_events = df.withColumn("_events", events(F.col(x), term_cap))
    if parts is None:
        return with_events.withColumn(into, F.array(*_over(with_events, partition_by, order_by, start))).drop("_events")
    rows = in_ranges(with_events, [*partition_by, *order_by], parts).withColumn("_range", range_of(F.col("_id")))
    keys = [*partition_by, "_range"]
    ends = [F.max(F.when(F.col("_events")[k].isNotNull(), F.struct("_id", F.col("_events")[k].alias("v"))))["v"].alias(f"_e{k}") for k in range(len(NAMES))]
    sums = rows.groupBy(*keys).agg(*ends)
    earlier = Window.partitionBy(*partition_by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.array(*[F.coalesce(F.last(f"_e{k}", ignorenulls=True).over(earlier), start[k]) for k in range(len(NAMES))])
    begins = sums.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], begins.alias("_begin"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = rows.join(begins, same)
    carried_in = _over(joined, keys, ["_id"], [F.col("_begin")[k] for k in range(len(NAMES))])
    return joined.withColumn(into, F.array(*carried_in)).select(*df.columns, into)


def carried(
    df: DataFrame, x: str, partition_by: list[str], order_by: list[str], into: str, of: Callable[[Column, Column], Column], initial: str = ""
) -> DataFrame:
    """Add ``of(text, state it begins in)``; null from a document's first null text on."""
    upto = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.col(x).isNull()).over(upto)
    found = with_state(df, x, partition_by, order_by, initial, "_state").withColumn("_lost", lost)
    return found.withColumn(into, F.when(~F.col("_lost"), of(F.col(x), F.col("_state")))).drop("_state", "_lost")


def stream_with_state(
    lines: DataFrame, x: str, document: str, order: str, into: str = "state_in", term_cap: tuple[str, ...] | None = None
) -> DataFrame:
    """Like ``with_state``, for a stream of lines: the columns ``document``, ``order``, ``x`` and the state that each line begins in.

    A document's registers are kept as the stream's state, so its lines may come in many batches, and go on
    after a restart from the stream's checkpoint. The lines of one batch are put in order; a line that comes
    in a later batch than lines behind it begins in the state that these have left, as a terminal would
    show it. A null text changes nothing. A document's lines of one batch are held by a task; the
    source's limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound them.
    """
    kept = [document, order, x]
    fields = [lines.schema[c] for c in kept]

    def run(key: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(memory.get[0].split(_BETWEEN)) if memory.exists else NONE
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        found, known = [], machine(term_cap)
        for text in rows[x]:
            found.append(_BETWEEN.join(state))
            state = known.end(state, text) if isinstance(text, str) else state
        memory.update((_BETWEEN.join(state),))
        yield rows.assign(**{into: found})[[*kept, into]]

    out = T.StructType([*fields, T.StructField(into, T.StringType())])
    memory = T.StructType([T.StructField("registers", T.StringType())])
    found = lines.select(*kept).groupBy(document).applyInPandasWithState(run, out, memory, "append", GroupStateTimeout.NoTimeout)
    # Spark gives Arrow functions the rows of this operator in a form that they can't take, unless something is computed between
    return found.select(document, order, F.concat(F.col(x), F.lit("")).alias(x), F.split(F.col(into), _BETWEEN, -1).alias(into))
