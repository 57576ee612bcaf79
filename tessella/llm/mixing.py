"""Mixing sources to target weights, by DataFrame operations only.

Each document draws the exponential key -ln(u) / weight, u from a hash of its id and weight its quality
(Efraimidis-Spirakis: the smallest keys are a weighted sample without replacement). A source's target is first met
by complete epochs of the source; the rest takes documents in key order while their prefix sum of words stays
nearest to it.

The prefix sum runs on two levels, so that a source with a third of all rows is no single sort: keys fall into
BUCKETS ordered ranges, whose sums are made in map-side partial aggregates; only the range in which the rest ends is
sorted. The result is a cut key per source, a table with a row per source that joins back to the documents.

Defined results: a null or empty text has size 0 and takes nothing; very long texts count whole; a null source is a source of its own; rows with the same
id and weight share a key and are taken together; an empty table gives an empty table. Columns of docs named like a
new one (they start with two underscores) give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, unit_hash, word_count

BUCKETS, SEED = 4096, "mix-1"
SYMBOLS = "#*$%&|<>"


def symbol_quality(text: Column) -> Column:
    """1 for text without symbols, down to 0.1 where a quarter of the characters or more are."""
    n = F.length(text)
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 4.0 * (n - F.length(F.translate(text, SYMBOLS, ""))) / F.nullif(n, F.lit(0))), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight of share of all words.

    Weights repeat over the sources by code point, null last. A target stops at most times its source; what it
    leaves goes to the others by weight. The table has a row per source and is sorted whole in one task: that is for
    sources as collections, not for as many hosts as there are documents. With sources in the order of cap / weight, a source is capped if its
    cap is under the level that those before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("words", share * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everything)["level"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, quality: Column | None = None, weights: Sequence[int] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """docs with __size, __source_size, __target, __copies (times that the mix takes the row) and __taken (words).

    size and quality are computed from the text unless given.
    """
    text = F.col(text_col).cast("string")
    key = -F.log(unit_hash(SEED, id_col)) / (symbol_quality(text) if quality is None else quality)
    held = docs.withColumns({"__size": word_count(text) if size is None else size, "__key": key}).withColumn("__bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("__key")))).cast("int"))
    rows = materialize(held.select(F.col(source_col).alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"), F.col("__bucket").alias("bucket")))
    sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal.withColumnRenamed("source", "of"))

    before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
    ends = sums.withColumn("before", before).join(goal, F.col("source").eqNullSafe(F.col("of")))
    ends = ends.where("before < rest AND rest <= before + size").select("of", "before", "rest", F.col("bucket").alias("at"))
    ends = materialize(ends)
    last = rows.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    last = last.groupBy("of", "before", "rest", "key").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("key"))
    cut = last.withColumn("upto", upto).where("2 * upto - size <= 2 * rest").groupBy("of").agg(F.max("key").alias("cut_key"))
    ends = ends.select(F.col("of").alias("end_of"), "at").join(cut.withColumnRenamed("of", "cut_of"), F.col("end_of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")
    plan = materialize(goal.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left").drop("end_of", "rest"))
    plan = plan.select(F.struct("of").alias("__of"), F.struct("source_size", "target", "epochs", "at", "cut_key").alias("__plan"))
    out = held.join(plan, F.col(source_col).eqNullSafe(F.col("__of.of")))
    extra = (F.col("__bucket") < F.col("__plan.at")) | (F.col("__key") <= F.col("__plan.cut_key"))
    copies = F.col("__plan.epochs") + F.coalesce(extra, F.lit(False)).cast("long")
    out = out.withColumns({"__source_size": F.col("__plan.source_size"), "__target": F.col("__plan.target"), "__copies": copies})
    return out.withColumn("__taken", F.col("__copies") * F.col("__size")).drop("__of", "__plan", "__key", "__bucket")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, numbered by mix_copy; other columns come through as they were."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "mix_copy"))
    held = docs.select(own.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("of_source"), F.col(f"`{text_col}`").alias("text"))
    out = mix(held, id_col="id", source_col="of_source", text_col="text", **how).where("__copies > 0")
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("mix_copy"))


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / coalesce(greatest(0.1, 1.0 - 4.0 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / nullif(length(text), 0)::DOUBLE), 1.0) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE
      ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.source, key, sum(size) AS size FROM d GROUP BY d.source, key),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k)
SELECT d.doc_id, d.size::BIGINT AS size, g.source_size, g.target,
       (d.size * (g.epochs + CASE WHEN 2 * p.upto - p.size <= 2 * (g.target - g.epochs * g.source_size) AND g.target > g.epochs * g.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key
"""
