"""robots.txt files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.policy import robots_allowed
from tessella.functions.text import strip


def parse_robots(files: DataFrame, agent: str, domain_col: str = "domain", body_col: str = "body") -> DataFrame:
    """(domain, allowed, disallowed) for an agent; a file without rules for it has empty lists.

    Each User-agent line starts a section anew. Sections of * and of names that contain the agent's or are contained
    in it count; the latter make the file specific. Without one only sections of exactly * count.
    """
    line = strip(F.col("line"))
    rows = files.select(F.col(domain_col).alias("domain"), F.posexplode(F.split(F.coalesce(F.col(body_col), F.lit("")), "\n")).alias("at", "line"))
    rows = rows.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit(":")))
    rows = rows.select("domain", "at", F.lower(strip(F.substring_index("line", ":", 1))).alias("key"), strip(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    rows = rows.where(F.col("key").isin("user-agent", "allow", "disallow"))
    named = F.lower(F.when(F.col("key") == "user-agent", F.col("value")))
    rows = rows.withColumn("section", F.last(named, ignorenulls=True).over(Window.partitionBy("domain").orderBy("at")))
    me = F.lit(agent.lower())
    rows = rows.withColumn("specific", (F.col("section") != "*") & (F.contains(me, F.col("section")) | F.contains(F.col("section"), me)))
    rules = rows.where("key <> 'user-agent' AND value <> ''").where("specific OR section = '*'")
    named_here = rows.groupBy("domain").agg(F.max("specific").alias("found"))
    kept = rules.groupBy("domain").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == k, F.struct("at", "value")))), lambda x: x["value"]).alias(name) for k, name in (("allow", "allowed"), ("disallow", "disallowed"))))
    empty = F.array().cast("array<string>")
    out = files.select(F.col(domain_col).alias("domain")).distinct().join(named_here, "domain", "left").join(kept, "domain", "left")
    return out.select("domain", F.coalesce("allowed", empty).alias("allowed"), F.coalesce("disallowed", empty).alias("disallowed"), F.coalesce("found", F.lit(False)).alias("specific"))


def check_robots(urls: DataFrame, rules: DataFrame, domain_col: str = "domain", path_col: str = "path") -> DataFrame:
    """urls with is_allowed; a domain without rules allows all."""
    held = rules.select(F.col("domain").alias("__domain"), "allowed", "disallowed")
    out = urls.join(held, F.col(domain_col) == F.col("__domain"), "left")
    return out.withColumn("is_allowed", robots_allowed(F.col(path_col), F.col("allowed"), F.col("disallowed"))).drop("__domain", "allowed", "disallowed")
