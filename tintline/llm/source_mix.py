"""Mixing sources to target weights by temperature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, words

#: The exponent is found on the grid k / GRID, by passes that each try FAN - 1 inner points.
GRID, FAN = 2**20, 32
#: Blocks whose sums are added up first: a source's window has a row for each such group, then one for each of its blocks.
BLOCK_GROUP = 1024
#: Sources up to which the plan, a short row for each, is broadcast; beyond, it is joined by shuffles.
SMALL_PLAN = 10_000


def _exponent(shares: DataFrame, target_entropy: float | None, max_epochs: float | None, budget_share: float | None) -> int:
    """Bisect the exponent's numerator; ``shares`` has p, a row for each source.

    The repetitions of the most repeated source and the mixture's entropy both fall
    as the exponent rises. Taken is the smallest exponent within ``max_epochs``, or
    the largest that keeps ``target_entropy`` (in nats); with both, the larger.
    Each pass is one aggregation that narrows the bracket FAN-fold.
    """

    def figures(k: int) -> list:
        a = F.lit(k / GRID)
        z, mixed = F.sum(F.pow("p", a)), F.sum(F.pow("p", a) * F.log("p"))
        ratio = F.pow("p", a - 1)
        most = F.max(ratio) / (F.min(ratio) if budget_share is None else z / F.lit(budget_share))
        return [most.alias(f"e{k}"), (F.log(z) - a * mixed / z).alias(f"h{k}")]

    def search(holds, lo: int, hi: int) -> tuple[int, int]:
        """``holds`` is false up to some point and true after it: the points beside the change."""
        while hi - lo > 1:
            step = max(1, -(-(hi - lo) // FAN))
            inner = list(range(lo + step, hi, step))
            row = shares.agg(*[x for k in inner for x in figures(k)]).first()
            for k in inner:
                if holds(row, k):
                    hi = k
                    break
                lo = k
        return lo, hi

    found = []
    if max_epochs is not None:
        found.append(search(lambda r, k: r[f"e{k}"] is None or r[f"e{k}"] <= max_epochs, -1, GRID)[1])
    if target_entropy is not None:
        found.append(search(lambda r, k: r[f"h{k}"] is not None and r[f"h{k}"] < target_entropy, 0, GRID + 1)[0])
    return max(found, default=GRID)


def mixing_plan(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget_tokens: int | None = None,
    rows_per_block: int = 1024,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per source: its weight, and how its permutations meet the budget.

    Columns: source, n_rows, tokens, weight, epochs, full_epochs, blocks, last_block,
    last_key. A source is taken whole ``full_epochs`` times; of the next permutation
    come the rows before and at (last_block, last_key), the longest prefix within
    the rest of the source's budget.
    """
    narrow = checkpointed(
        docs.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"),
            F.col(source_col).alias("s"),
            F.size(words(F.col(text_col))).cast("long").alias("t"),
        )
    )
    sums = narrow.groupBy("s").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("t").alias("tokens"))
    sums = checkpointed(sums)
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.filter("tokens > 0").select((F.col("tokens") / F.lit(float(max(1, total)))).alias("p"))
    budget_share = None if budget_tokens is None else budget_tokens / max(1, total)
    a = _exponent(shares, target_entropy, max_epochs, budget_share) / GRID
    p = F.col("tokens") / F.lit(float(max(1, total)))
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    z, least = z or 1.0, least or 1.0
    epochs = F.pow(p, F.lit(a - 1)) / F.lit(least) if budget_tokens is None else F.pow(p, F.lit(a - 1)) * budget_share / F.lit(z)
    plan = sums.select(
        "s",
        "n_rows",
        "tokens",
        F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0)).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(epochs, 9)).otherwise(F.lit(1.0)).alias("epochs"),
        F.ceil(F.col("n_rows") / rows_per_block).alias("blocks"),
    ).withColumn("full_epochs", F.floor("epochs"))
    plan = plan.withColumn("rest", F.floor((F.col("epochs") - F.col("full_epochs")) * F.col("tokens")))
    # where the last permutation's budget ends: among groups of blocks, then blocks, then rows
    plan = checkpointed(plan)
    small = _few(plan)  # none of what follows has more rows than there are sources
    dealt = narrow.join(small(plan).select(F.col("s").alias("ps"), "blocks", "full_epochs", "rest"), F.col("s").eqNullSafe(F.col("ps"))).select(
        "s", "t", "rest", perm_key("i", "full_epochs", seed).alias("k"), "blocks"
    ).withColumn("b", block_of("k", "blocks")).withColumn("g", F.floor(F.col("b") / BLOCK_GROUP))
    first = checkpointed(_edge(dealt.withColumn("before", F.lit(0).cast("long")), "g"))
    group = dealt.join(small(first), F.col("s").eqNullSafe(F.col("es")) & (F.col("g") == F.col("e"))).drop("es", "e")
    edge = checkpointed(_edge(group, "b"))
    within = Window.partitionBy("s").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        dealt.join(small(edge), F.col("s").eqNullSafe(F.col("es")) & (F.col("b") == F.col("e")))
        .withColumn("upto", F.col("before") + F.sum("t").over(within))
        .groupBy("s", "e")
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("k"))).alias("last_key"))
        .select(F.col("s").alias("es"), F.col("e").alias("last_block"), "last_key")
    )
    return plan.join(last, F.col("s").eqNullSafe(F.col("es")), "left").select(
        F.col("s").alias("source"), "n_rows", "tokens", "weight", "epochs", "full_epochs", "blocks",
        F.when(F.col("rest") > 0, F.coalesce("last_block", "blocks")).otherwise(F.lit(-1)).alias("last_block"),
        F.coalesce("last_key", F.lit("")).alias("last_key"),
    )


def _few(plan: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables with a row for each source are joined with rows: by broadcast, once it is counted that they are few."""
    return F.broadcast if plan.limit(SMALL_PLAN + 1).count() <= SMALL_PLAN else lambda df: df


def _edge(dealt: DataFrame, by: str) -> DataFrame:
    """(es, e, before): each source's value of ``by`` that the budget ends in, and the tokens before it."""
    so_far = Window.partitionBy("s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.groupBy("s", by, "rest", "before")
        .agg(F.sum("t").alias("bt"))
        .withColumn("upto", F.col("before") + F.sum("bt").over(so_far))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("s")
        .agg(F.min_by(F.struct(F.col(by).alias("e"), (F.col("upto") - F.col("bt")).alias("before")), by).alias("x"))
        .select(F.col("s").alias("es"), "x.e", "x.before")
    )


def perm_key(i: str, epoch: str, seed: int):
    """The place of a row in its source's permutation for an epoch: keys sort in random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.col(i)))


def block_of(key: str, blocks: str):
    """Blocks are ranges of keys, so a permutation sorted by key runs block after block."""
    return F.floor(F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long") * F.col(blocks) / F.lit(2.0**32)).cast("long")


def mix_rows(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mixture: rows (row, epoch, block, perm_key), one for each time that a row is taken.

    ``row`` is the whole row of ``docs`` as a struct. Sources get weights in
    proportion to their token shares to the power of an exponent, which is bisected
    to meet ``target_entropy`` or ``max_epochs``. Without ``budget_tokens`` the budget
    is the least that takes every row once: the sources that the temperature cuts
    most are taken once, others as often as their weight asks. In the order (epoch,
    block, perm_key) each source's rows are whole permutations and the start of one.

    A null source is a source. Null or blank texts have no tokens; a source of only
    such rows is taken once. Null ids sort as the string "null"; rows that share an
    id stand together in every permutation and are taken or left together. Columns
    of any name may follow; they are carried along. An empty table gives none.

    The rows themselves are joined with one small row per source, by broadcast for up
    to SMALL_PLAN sources, and are not moved otherwise.
    """
    plan = mixing_plan(docs, seed=seed, id_col=id_col, source_col=source_col, **options)
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"),
        F.col(source_col).alias("s"),
    )
    plan = checkpointed(plan)
    taken = row.join(_few(plan)(plan), F.col("s").eqNullSafe(F.col("source"))).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_epochs")))
    )
    taken = taken.withColumn("perm_key", perm_key("i", "epoch", seed)).withColumn("block", block_of("perm_key", "blocks"))
    whole = F.col("epoch") < F.col("full_epochs")
    before = (F.col("block") < F.col("last_block")) | (
        (F.col("block") == F.col("last_block")) & (F.col("perm_key") <= F.col("last_key"))
    )
    return taken.filter(whole | before).select("row", "source", "weight", "epoch", "block", "perm_key")
