"""URL filters by a sort-merge range join, in DataFrame operations only.

Method: a rule (host, path) becomes the canonical key ``reversed host labels + path``; the keys with that prefix are
one interval. Rule intervals nest or are apart, so a sorted sweep that pushes a rule at its start and pops it at its
end keeps a stack of the active nested rules. The stack after each start and end is fixed by the rules alone, so it is
stored with that break point; a key's stack is that of the last break point before it. Keys and break points are
range-partitioned by key (equal keys may span partitions), each partition is swept by itself, and the stack left by the
partitions before it is carried in from one row per partition.

A rule fits subdomains too, hence a URL takes part once for each number of labels that rule hosts have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(empty), F.when(has, path).otherwise(empty)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _canonical(host: Column, path: Column, labels: Column) -> Column:
    """The first ``labels`` labels of the reversed host, then the path, as bytes."""
    return F.encode(F.concat(F.array_join(F.slice(F.reverse(_labels(host)), F.lit(1), labels), "."), path), "UTF-8")


def _break_points(rules: DataFrame) -> DataFrame:
    """``(key, stack)``: at each start and end of a rule's interval, the rules active from there on, outermost first."""
    r = rules.select("rule", "verdict", _canonical(F.col("host"), F.col("path"), F.size(_labels(F.col("host")))).alias("key"))
    item = F.struct(F.length("key").alias("depth"), F.col("rule"), F.col("verdict"))
    own = r.select("key", item.alias("item"))
    # The rules around a rule are those whose key is a prefix of its key: an equality join on every shorter prefix.
    inner = r.select(F.col("key").alias("of"), F.explode(F.expr("sequence(1, length(key))")).alias("n"))
    inner = inner.select("of", F.expr("substring(of, 1, n)").alias("key"))
    stacks = inner.join(own, "key").groupBy("of").agg(F.array_sort(F.collect_list("item")).alias("stack"))
    starts = stacks.select(F.col("of").alias("key"), "stack")
    ends = stacks.select(
        F.concat("of", F.lit(b"\xff")).alias("key"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack")
    )
    return starts.union(ends)


def judge(
    pages: DataFrame, rules: DataFrame, id_cols: tuple[str, ...] = ("page_id",), url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Each row's URL against ``rules(host, path, verdict)``: ``id_cols, host, path, rule, verdict, stack``.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; of the fitting rules the
    longest (``host || path``) wins, ``stack`` holds those around it with equally many labels. Without a fitting rule:
    rule null, verdict ``default``, stack empty. Host letters of rules are lower-cased; of two verdicts for one rule
    ``block`` stays. Null URLs and URLs without ``://`` have empty host and path. Rows with null or repeated ids are
    kept as they are. Empty tables of pages or rules are fine.
    """
    spark = pages.sparkSession
    pages = pages.select(*id_cols, F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    rules = rules.groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict"))
    rules = rules.withColumn("rule", F.concat("host", "path"))
    sizes = sorted(r[0] for r in rules.select(F.size(_labels(F.col("host")))).distinct().collect())  # few: labels of a host

    urls = pages.groupBy("_url").agg(F.count("*").alias("_copies")).select("_url", host.alias("host"), path.alias("path"))
    levels = urls.withColumn("labels", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")))
    levels = levels.where(F.size(_labels(F.col("host"))) >= F.col("labels"))
    keys = levels.select(
        _canonical(F.col("host"), F.col("path"), F.col("labels")).alias("key"), F.lit(1).alias("kind"), F.col("_url").alias("url"),
        F.lit(None).cast("array<struct<depth:int,rule:string,verdict:string>>").alias("stack"),
    )
    breaks = _break_points(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "stack")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.union(breaks).repartitionByRange(parts, "key", "kind", "url").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sweep")

    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("own", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    # One row a partition: what its last break point leaves on the stack, carried to the partitions after it.
    left = dealt.where("kind = 0").groupBy("part").agg(F.max_by("stack", F.struct("key", "kind")).alias("left"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(left, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("left", ignorenulls=True).over(before).alias("carried"))
    active = swept.join(F.broadcast(carried), "part").select("url", F.coalesce("own", "carried").alias("stack"))

    top = F.element_at("stack", -1)
    best = (
        active.where("size(stack) > 0")
        .withColumn("top", top)
        .groupBy("url")
        .agg(F.max_by(F.struct("top", "stack"), F.struct(F.length("top.rule"), F.col("top.rule"))).alias("best"))
        .select(F.col("url").alias("_url"), "best")
    )
    return pages.join(best, "_url", "left").select(
        *id_cols,
        host.alias("host"),
        path.alias("path"),
        F.col("best.top.rule").alias("rule"),
        F.coalesce("best.top.verdict", F.lit(default)).alias("verdict"),
        F.coalesce("best.stack.rule", F.array().cast("array<string>")).alias("stack"),
    )
