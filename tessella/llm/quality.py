"""Quality rules with thresholds from the data, per language and source.

Each document's base counts give rates in whole steps of a thousandth. A histogram of the steps is a mergeable
quantile sketch with an error of one step at most: partial sketches add up, over tasks and from sources to their
language, and none grows past STEPS entries a rate. A rate's threshold is its upper quartile plus FENCE quartile
distances (FLOOR steps at least); word length also has a lower one. A group's quartiles are shrunk towards its
language's as if the language gave it PRIOR documents, so small groups have nearly their language's fences and large ones
their own. The thresholds join back to the documents by language and source.

Defined results: null text has no words and fails the base rules; null language or source is a group of its own; a rate
without a base (no words, no lines) is 0. Repeated rows and ids count and are judged row by row. A value on a threshold is
kept. Very long texts are counted whole. An empty table gives an empty table. Columns of docs named like a new one stay
out of scores and come through filters as they were.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import map_texts, materialize

FENCE, PRIOR, STEPS = 3, 50, 1000
#: Rate -> the least quartile distance in steps. Where most documents have none of a thing both quartiles meet, and the
#: distance is this: in all groups of the sf0.1 documents. Without it 12 % of them more would go, of those labelled good 5 %.
FLOOR = {"symbols": 15, "capitals": 40, "marks": 30, "dup_lines": 120, "repeats": 100, "word_length": 100}
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_marks bigint"

_KIND = np.zeros(256, np.uint8)
_KIND[0x80:0xC0] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 2
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[[ord(c) for c in "!?"]] = 5


def count(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS."""
    words = text.split()
    _, _, space, symbols, capitals, marks = kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), int(kinds.sum() - kinds[1] - space), int(symbols), len(lines) - len(set(lines)), repeated, len(lines), int(capitals), int(marks)


def _counter() -> Callable[[list[bytes]], dict]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return lambda batch: dict(zip(names, zip(*map(count, batch), strict=True), strict=True))


def _rates(at: str = "") -> Column:
    """An array of (rate, step)."""
    c = lambda x: F.col(f"{at}{x}")
    step = lambda n, of: F.least(F.lit(STEPS), F.floor(F.coalesce(STEPS * n / of, F.lit(0)))).cast("int")
    rates = {"symbols": (c("n_symbols"), c("word_chars")), "capitals": (c("n_capitals"), c("word_chars")), "marks": (c("n_marks"), c("word_chars")), "dup_lines": (c("n_dup_lines"), c("n_lines")), "repeats": (c("n_repeat_words"), c("n_words")), "word_length": (c("word_chars"), 30 * c("n_words"))}
    return F.array(*(F.struct(F.lit(k).alias("rate"), step(n, F.nullif(of, F.lit(0))).alias("step")) for k, (n, of) in rates.items()))


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, limits), limits a map from rate to (low, high), of documents with COUNTS, lang and source."""
    sketch = counted.select("lang", "source", F.inline(_rates())).groupBy("lang", "source", "rate", "step").agg(F.count("*").alias("n"))
    sketch = materialize(sketch)
    wide = sketch.groupBy("lang", "rate", "step").agg(F.sum("n").alias("n"))

    def quartiles(of: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "rate")
        upto = of.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step")))
        return upto.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(0.25).alias("low"), at(0.75).alias("high"))

    own, lang = quartiles(sketch, ["lang", "source"]), quartiles(wide, ["lang"]).select(F.col("lang").alias("of"), F.col("rate").alias("of_rate"), F.struct("low", "high").alias("wide"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("rate") == F.col("of_rate")))
    low, high = ((F.col("n") * F.col(c) + PRIOR * F.col(f"wide.{c}")) / (F.col("n") + PRIOR) for c in ("low", "high"))
    floor = F.element_at(F.create_map(*(F.lit(x) for kv in FLOOR.items() for x in kv)), F.col("rate"))
    reach = FENCE * F.greatest(high - low, floor)
    limits = F.struct(F.when(F.col("rate") == "word_length", low - reach).otherwise(F.lit(-1.0)).alias("low"), (high + reach).alias("high"))
    return materialize(both.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", limits))).alias("limits")))


def base_failed(at: str = "") -> Column:
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def _verdict(limits: Column, at: str = "") -> Column:
    inside = F.forall(_rates(at), lambda r: r["step"].between(limits[r["rate"]]["low"], limits[r["rate"]]["high"]))
    return ~base_failed(at) & inside


def score_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, COUNTS, base_failed and kept, for each row of docs."""
    slim = docs.select(F.struct(*keep).alias("key"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = materialize(map_texts(slim, "text", _counter, COUNTS, ["key", "lang", "source"]))
    limits = thresholds(counted).toDF("of_lang", "of_source", "limits")
    out = counted.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return out.select("key.*", *names, base_failed().alias("base_failed"), _verdict(F.col("limits")).alias("kept"))


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass; texts are read twice and not shuffled."""
    slim = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    limits = thresholds(map_texts(slim, "text", _counter, COUNTS, ["lang", "source"])).toDF("__lang", "__source", "__limits")
    held = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("__row"), F.col(lang_col).alias("__of_lang"), F.col(source_col).alias("__of_source"), F.col(text_col).alias("__words"))
    out = map_texts(held, "__words", _counter, COUNTS, ["__row", "__of_lang", "__of_source"])
    out = out.join(limits, F.col("__of_lang").eqNullSafe(F.col("__lang")) & F.col("__of_source").eqNullSafe(F.col("__source")))
    return out.where(_verdict(F.col("__limits"))).select("__row.*")
