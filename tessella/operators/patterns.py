"""Many patterns against many URLs without a product of the two.

Each pattern is posted under one gram of its own, the one that the fewest URLs hold. A URL meets the patterns posted under
its grams and is tested against those alone, so the work follows the grams in common. Patterns with fewer characters than
a gram are posted under all they have; grams of those sizes are made of the URLs too.

Defined results: stars at the ends open that end, a bare pattern is contained in the URL or is all of it; a pattern of nothing
but one star or two matches all; the empty pattern matches all where bare ones are contained, else the empty URL. Null URLs
and null patterns match nothing; repeated patterns count once; repeated URLs are matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.policy import pattern_blocks
from tessella.operators.joins import join_unique
from tessella.sources.staging import materialize

#: Characters of a gram.
GRAM = 5


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of a size that a text holds."""
    n = F.char_length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _needle(pattern: Column) -> Column:
    """What a URL must hold: the pattern without the star at either end."""
    tail = F.when(F.startswith(pattern, F.lit("*")), F.substring(pattern, F.lit(2), F.char_length(pattern))).otherwise(pattern)
    return F.when(F.endswith(tail, F.lit("*")), F.substring(tail, F.lit(1), F.char_length(tail) - 1)).otherwise(tail)


def pattern_matches(urls: DataFrame, url: str, patterns: DataFrame, pattern: str = "pattern", bare_is_whole: bool = False) -> DataFrame:
    """(url, pattern): every pair that matches, once."""
    asked = materialize(urls.where(F.col(url).isNotNull()).select(F.col(url).alias("__url")).distinct().withColumn("__id", F.xxhash64("__url")))
    known = materialize(patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("__pattern"), _needle(F.col(pattern)).alias("__needle")).distinct())
    test = pattern_blocks(F.col("__url"), F.col("__pattern"), bare_is_whole)
    broad = known.where("__needle = ''").select("__pattern")
    sizes = [r[0] for r in known.where("__needle <> ''").select(F.least(F.char_length("__needle"), F.lit(GRAM)).alias("n")).distinct().collect()]

    own = F.concat(*(F.when(F.least(F.char_length("__needle"), F.lit(GRAM)) == n, _grams(F.col("__needle"), n)).otherwise(F.array().cast("array<string>")) for n in sizes)) if sizes else F.array().cast("array<string>")
    posts = known.where("__needle <> ''").select("__pattern", F.explode(own).alias("__gram"))
    wanted = posts.select("__gram").distinct()
    # A URL travels as its hash; URLs of one hash are told apart by the test.
    said = asked.select("__id", F.explode(F.concat(*(_grams(F.col("__url"), n) for n in sizes)) if sizes else F.array().cast("array<string>")).alias("__gram"))
    held = materialize(said.join(wanted, "__gram", "left_semi"))
    often = held.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = posts.join(often, "__gram", "left").groupBy("__pattern").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("r"))
    index = rarest.where("r.n > 0").groupBy(F.col("r.gram").alias("__gram")).agg(F.collect_list("__pattern").alias("__patterns"))
    near = join_unique(held, index, "__gram", F.col("__id")).where("__patterns IS NOT NULL").select("__id", F.explode("__patterns").alias("__pattern")).distinct()
    found = near.join(asked, "__id").where(test).select("__url", "__pattern")
    if broad.limit(1).count():  # three patterns at most
        found = found.unionByName(asked.join(F.broadcast(broad.limit(4)), test).select("__url", "__pattern"))
    return found.select(F.col("__url").alias(url), F.col("__pattern").alias(pattern))


def blocked_by(rows: DataFrame, url: str, patterns: DataFrame, pattern: str = "pattern", bare_is_whole: bool = False) -> DataFrame:
    """rows with blocked: whether any pattern matches their URL; false for a null URL."""
    hits = pattern_matches(rows, url, patterns, pattern, bare_is_whole).select(F.col(url).alias("__blocked")).distinct().withColumn("blocked", F.lit(True))
    out = join_unique(rows.drop("blocked").withColumn("__blocked", F.col(url)), materialize(hits), "__blocked", F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind)))
    return out.drop("__blocked").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
