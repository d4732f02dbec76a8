"""URL filters: allow and block rules as a sort-merge range join.

The canonical key of a host is its labels in reverse order, each followed by a
dot: ``www.example.net`` becomes ``net.example.www.``. What begins with a rule's key
is an interval of the order, and intervals nest or are disjoint. So the rules that
may fit a key are the last key of a rule at or before it and those that this one lies
in: each rule carries that stack, and a sweep over the union of URLs and rules in
key order hands the latest stack on. A first sweep finds the ruled hosts that a URL's
host lies in, a second, by ruled host and path, the rules of each: in both a stack
is as long as rules nest, however many rules a host has. The longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to ``/ ? #``, the path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _swept(rows: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the ``stack`` of the last of ``points`` at or before each in the order of ``by``.

    Rows (with a unique ``uid``) and points are range-partitioned by ``by`` and uid, so a key
    with a third of all rows is spread. Each partition is swept on its own; the stack that it
    starts with is the last one of the partitions before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(points.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = checkpointed(both.repartitionByRange(n, *by, "kind", "uid").withColumn("part", F.spark_partition_id()))
    # one row for each partition
    last = dealt.groupBy("part").agg(F.max_by(F.when(F.col("kind") == 0, F.col("stack")), F.when(F.col("kind") == 0, F.struct(*by))).alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(F.col("part").alias("of"), F.last("own", ignorenulls=True).over(before).alias("carry"))
    sweep = Window.partitionBy("part").orderBy(*by, "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("here", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    joined = swept.join(carry, F.col("part") == F.col("of"), "left")
    return joined.withColumn("stack", F.coalesce("here", "carry")).drop("kind", "part", "of", "here", "carry")


def _host_points(rules: DataFrame) -> DataFrame:
    """(key, stack): each ruled host's key, and the keys of the ruled hosts that it lies in, itself included."""
    own = rules.select("key").distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    depth = own.select("key", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("d"), labels.alias("labels"))
    above = depth.select("key", F.concat(F.array_join(F.slice("labels", 1, F.col("d")), "."), F.lit(".")).alias("a"))
    return above.join(own.withColumnRenamed("key", "a"), "a").groupBy("key").agg(F.collect_list("a").alias("stack"))


def _path_points(rules: DataFrame) -> DataFrame:
    """(host_key, path, stack): each rule's path, and those of its host's rules that it begins with."""
    best = rules.groupBy("key", "path").agg(F.min(F.struct("rule", "verdict")).alias("r"))
    starts = best.select("key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    starts = starts.select("key", "path", F.expr("substring(path, 1, n)").alias("start"))
    named = best.select("key", F.col("path").alias("start"), F.struct(F.col("key").alias("of"), "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).alias("x"))
    found = starts.join(named, ["key", "start"]).groupBy("key", "path").agg(F.collect_list("x").alias("stack"))
    return found.select(F.col("key").alias("host_key"), "path", "stack")


def url_filters(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every URL by the longest rule that fits it.

    ``rules`` has host, path and verdict. A rule fits its host and all its
    subdomains if the URL's path starts with the rule's path. The longest rule
    (host and path together) wins; of equally long ones the first by name.

    Returns one row per row of ``pages``: page_id, host, path, rule, verdict. A
    null URL, or one without ``://``, has an empty host and path, no rule and the
    default verdict. Repeated rows and null ids are judged like any other; other
    columns of ``pages`` are not read. Rules with a null or empty host or a null
    path fit nothing; without rules all get the default.

    URLs are dealt out by ranges of keys and rows, so a host with a third of all rows is
    spread over several partitions, and so is a path of a host. A URL meets a row for
    each ruled host that its host lies in, and carries rules as far as they nest.
    """
    host, path = host_and_path(F.col("u"))
    named = checkpointed(
        pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"))
        .withColumn("uid", F.monotonically_increasing_id())
        .select("uid", "i", host.alias("h"), path.alias("p"))
    )
    ruled = rules.filter("host IS NOT NULL AND path IS NOT NULL AND host != ''").select(lower_ascii(F.col("host")).alias("h"), "path", "verdict")
    ruled = checkpointed(ruled.select(reversed_key(F.col("h")).alias("key"), "path", F.concat("h", "path").alias("rule"), "verdict"))
    hosts = _swept(named.select(reversed_key(F.col("h")).alias("key"), "uid", "p"), _host_points(ruled), ["key"])
    # the last stack may be of a host that this one doesn't lie in
    hosts = hosts.select("uid", "p", F.explode(F.filter("stack", lambda a: F.col("key").startswith(a))).alias("host_key"))
    paths = _swept(hosts.withColumnRenamed("p", "path"), _path_points(ruled), ["host_key", "path"])
    fits = paths.select("uid", F.explode(F.filter("stack", lambda r: (r["of"] == F.col("host_key")) & F.col("path").startswith(r["path"]))).alias("r"))
    best = fits.groupBy("uid").agg(F.min(F.struct((-F.length("r.rule")).alias("n"), "r.rule", "r.verdict")).alias("r"))
    return named.join(best.select("uid", "r.rule", "r.verdict"), "uid", "left").select(
        F.col("i").alias(id_col), F.col("h").alias("host"), F.col("p").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
