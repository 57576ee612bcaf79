"""Chat formatting by linking quotations to the messages they quote, by DataFrame operations only.

A line's quote level is the number of > before its text. Consecutive lines of one level above 0 are a passage; its
normalised words are hashed. Messages post their own text, its paragraphs, lines and sentences under the same hash, in their
conversation; the first message to post a hash is the original of every later passage with it. A passage of several
lines that was not posted whole links by its lines instead. A message replies to the original of its first linked
passage, else to the greatest turn of its conversation before its own. Its reply depth and the turn that its thread
starts with are found by pointer doubling, so (thread, depth, turn) is an order of conversations without quotes in which
each message follows what it replies to. Quotes, and the line that introduces one, leave the text.

Only hashes and keys are shuffled by conversation and hash; what many messages share is folded to its first
message before any join.

Defined results: null text is empty and stays so; rows equal in conversation and turn are told apart by their text, equal rows
stay as they are; a message with a null conversation or turn links to nothing, has depth 0 and quotes nothing;
passages without letters or digits are dropped but not linked. Turns may have gaps. Very long texts are parsed whole.
Of several originals the first turn counts. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
INTRODUCES = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"


def normal(text: Column) -> Column:
    """Words in lower case with single spaces; marks and quote signs go."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """An array of (level, text) of the lines."""
    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, QUOTE, 0)
        return F.struct((F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, QUOTE, "").alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def _body(lines: Column) -> Column:
    """The text of level 0 without lines that introduce a quote."""
    keep = F.filter(
        F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)).alias("next"))),
        lambda x: (x["level"] == 0) & ~((x["next"] > 0) & x["line"].rlike(INTRODUCES)),
    )
    return F.regexp_replace(F.array_join(F.transform(keep, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def _turn_before(turns: DataFrame, steps: tuple[int, ...] = (10, 10, 20, 23)) -> DataFrame:
    """(conv, turn, before) of distinct (conv, turn): the greatest smaller turn, null for the first.

    Turns are sorted in ranges of 2**steps[0], ranges' last turns in ranges of ranges, so no task sorts a conversation.
    """
    at = turns.select("conv", "turn", F.col("turn").cast("long").alias("b"), F.col("turn").alias("top"))

    def solve(rows: DataFrame, left: tuple[int, ...]) -> DataFrame:
        rows = rows.withColumn("up", F.shiftright("b", left[0]) if left else F.lit(0))
        rows = rows.withColumn("before", F.lag("top").over(Window.partitionBy("conv", "up").orderBy("b")))
        if not left:
            return rows.drop("up")
        above = rows.groupBy("conv", F.col("up").alias("b")).agg(F.max("top").alias("top"))
        above = solve(above, left[1:]).select("conv", F.col("b").alias("up"), F.col("before").alias("further"))
        return rows.join(above, ["conv", "up"]).withColumn("before", F.coalesce("before", "further")).drop("up", "further")

    return solve(at, steps).select("conv", "turn", "before")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, turn, role, body, n_quotes, n_linked, reply_to (a turn), depth, thread (a turn): a row for each message."""
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))
    lined = base.withColumn("lines", _lines(F.col("text"))).withColumn("body", _body(F.col("lines")))

    body = F.col("body")
    units = F.array_distinct(F.concat(F.array(body), F.split(body, r"\n[ \t\r]*\n"), F.split(body, "\n"), F.split(body, r"(?<=[.!?])\s+")))
    posted = lined.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.explode(F.array_distinct(F.transform(units, normal))).alias("words")).where("words <> ''")
    originals = posted.select("conv", "turn", F.md5("words").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("original"))

    # A passage starts where the level changes: lines are numbered by the starts before them.
    quoting = lined.where("conv IS NOT NULL AND turn IS NOT NULL").where(F.exists("lines", lambda x: x["level"] > 0)).select("conv", "turn", "key", "lines").dropDuplicates(["conv", "turn", "key"])
    starts = F.transform(F.col("lines"), lambda x, i: F.when((i == 0) | (x["level"] != F.coalesce(F.try_element_at(F.col("lines"), F.when(i == 0, F.lit(1)).otherwise(i))["level"], F.lit(-1))), i))
    quoting = quoting.withColumn("starts", F.filter(starts, lambda i: i.isNotNull()))
    passages = quoting.select("conv", "turn", "key", F.posexplode("starts").alias("n", "first"), "lines", "starts")
    size = F.coalesce(F.try_element_at("starts", F.col("n") + 2), F.size("lines")) - F.col("first")
    passages = passages.select("conv", "turn", "key", "n", F.slice("lines", F.col("first") + 1, size).alias("part")).where(F.col("part")[0]["level"] > 0)
    whole = F.array_join(F.transform("part", lambda x: x["line"]), "\n")
    quoted = F.transform(F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("rank"), whole.alias("said"))), F.transform("part", lambda x: F.struct(F.lit(1).alias("rank"), x["line"].alias("said"))))), lambda x: F.struct(x["rank"].alias("rank"), normal(x["said"]).alias("words")))
    passages = materialize(passages.select("conv", "turn", "key", "n", F.inline(quoted)).select("conv", "turn", "key", "n", "rank", F.when(F.col("words") != "", F.md5("words")).alias("hash")))
    links = passages.where("hash IS NOT NULL").join(originals, ["conv", "hash"]).where("original < turn")
    links = links.groupBy("conv", "turn", "key", "n").agg(F.min_by("original", F.struct("rank", "original")).alias("original"))
    linked = links.groupBy("conv", "turn", "key").agg(F.min_by("original", "n").alias("quoted_turn"), F.count("*").alias("n_linked"))
    counts = passages.groupBy("conv", "turn", "key").agg(F.countDistinct("n").alias("n_quotes"))

    known = materialize(linked.join(counts, ["conv", "turn", "key"], "right"))
    parent = base.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn").distinct()
    first = known.groupBy("conv", "turn").agg(F.min("quoted_turn").alias("quoted_turn"))
    tree = _turn_before(parent).join(first, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("quoted_turn", "before").alias("reply_to"))
    tree = materialize(tree.withColumns({"jump": F.col("reply_to"), "thread": F.coalesce("reply_to", "turn"), "depth": F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long")}))
    while tree.where("jump IS NOT NULL").limit(1).count():
        up = tree.select(F.col("conv"), F.col("turn").alias("jump"), F.col("jump").alias("further"), F.col("depth").alias("more"), F.col("thread").alias("start"))
        after = tree.join(up, ["conv", "jump"], "left").select("conv", "turn", "reply_to", F.col("further").alias("jump"), F.coalesce("start", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        after = materialize(after)
        discard(tree)
        tree = after

    out = lined.select("conv", "turn", "role", "key", "body").join(tree.drop("jump"), ["conv", "turn"], "left").join(known.drop("quoted_turn"), ["conv", "turn", "key"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", zero("n_quotes"), zero("n_linked"), "reply_to", zero("depth"), "thread")
