"""Joins that Spark has no operator for: by the last row before, and to unique keys that a few rows' keys dominate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that stay together, at the least.
TOGETHER = 10_000


def join_unique(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """left with the columns of right, whose keys are unique and never null; null where right lacks a key.

    Keys that hold more than a task's fair share of left's rows are dealt out by a hash of `spread`, and right's rows of these
    keys, fewer than four for each shuffle partition, are repeated for it. left is read three times.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).collect()[0][0] or 0
    share = max(TOGETHER, total // (4 * parts))
    hot = counts.where(F.col("__n") > share).select("__hot", F.ceil(F.col("__n") / share).cast("int").alias("__salts")).collect()
    others = [c for c in right.columns if c != key]
    if not hot:
        return left.join(right.select(F.col(key).alias("__key"), *others), F.col(key) == F.col("__key"), "left").drop("__key")
    salts = left.sparkSession.createDataFrame(hot, "__hot " + dict(counts.dtypes)["__hot"] + ", __salts int")
    known = F.broadcast(salts)
    mine = left.join(known, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1)).cast("long"))).drop("__hot", "__salts")
    theirs = right.join(known, F.col(key) == F.col("__hot"), "left")
    theirs = theirs.select(F.col(key).alias("__key"), *others, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1)).alias("__of"))
    return mine.join(theirs, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__of")), "left").drop("__key", "__salt", "__of")


def time_ranges(log: DataFrame, asks: DataFrame, at: str, ranges: int | None = None) -> Column:
    """Which of so many ranges of about equal numbers of rows of both a row's `at` lies in; one for each shuffle partition if not said."""
    if ranges is None:
        ranges = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges: list = []
    if ranges > 1:
        spots = F.percentile_approx(F.col(at), [k / ranges for k in range(1, ranges)], 1000)
        edges = sorted(set(log.select(at).unionByName(asks.select(at)).agg(spots).collect()[0][0] or []))
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col(at))) if edges else F.lit(0)


def as_of(asks: DataFrame, log: DataFrame, by: list[str], at: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """asks with the values of the last log row of the same `by` whose `at` is no later than theirs; null where there is none.

    A key's history is cut into time ranges of about equal numbers of rows, so no task holds a key's whole history: each range
    starts from the last row of the ranges before it, which a partial aggregate finds, and is walked in order once. Of log
    rows equal in `by` and `at` the one with the largest values counts. Rows with a null `at` find nothing and are not found.
    """
    cut = time_ranges(log, asks, at, ranges)
    names = [c for c in asks.columns if c not in by]
    held = F.struct(*values)
    told = log.where(F.col(at).isNotNull()).select(*by, cut.alias("__range"), F.col(at).alias("__at"), F.lit(0).alias("__ask"), held.alias("__held"))
    last = told.groupBy(*by, "__range").agg(F.max(F.struct("__at", "__held")).alias("__last"))
    # A range's last row is what the next ranges start from: found over ranges, of which a key has few.
    asked = asks.where(F.col(at).isNotNull()).select(*by, cut.alias("__range"), F.struct(*names).alias("__asked"))
    every = last.select(*by, "__range", "__last").unionByName(asked.select(*by, "__range").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)))
    every = every.groupBy(*by, "__range").agg(F.max("__last").alias("__last"))
    ahead = F.last("__last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.withColumn("__held", ahead["__held"]).where("__held IS NOT NULL").select(*by, "__range", F.lit(None).cast(told.schema["__at"].dataType).alias("__at"), F.lit(0).alias("__ask"), "__held")
    none = F.lit(None).cast(asked.schema["__asked"].dataType)
    rows = told.unionByName(carried).withColumn("__asked", none).unionByName(asked.select(*by, "__range", F.col(f"__asked.{at}").alias("__at"), F.lit(1).alias("__ask"), F.lit(None).cast(told.schema["__held"].dataType).alias("__held"), "__asked"))
    # Dealt out by range as well: rows that lie together by a part of the keys would else stay so.
    rows = rows.repartition(*by, "__range")
    w = Window.partitionBy(*by, "__range").orderBy(F.asc_nulls_first("__at"), "__ask", "__held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__now", F.last("__held", ignorenulls=True).over(w)).where("__ask = 1")
    out = found.select(*by, "__asked.*", *(F.col(f"__now.{v}").alias(v) for v in values))
    lost = asks.where(F.col(at).isNull())
    return out.unionByName(lost.select(*by, *names, *(F.lit(None).cast(log.schema[v].dataType).alias(v) for v in values)))
