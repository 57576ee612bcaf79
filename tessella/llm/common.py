"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import discard, materialize, shared_dir, sweep  # noqa: F401  the corpus operators take them from here

#: A word: a longest run without ASCII white space. bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a Python task holds at once, so that its memory does not follow Spark's batch size.
CHUNK = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def unit_hash(seed: str, *cols: str) -> Column:
    """A reproducible number in (0, 1) from md5, the same on any engine; nulls count as a text of their own."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, text_col: str, score: Callable[[], Callable[[list[bytes]], dict[str, list]]], fields: str, keep: list[str] | None = None) -> DataFrame:
    """Adds columns made from a text column, chunk by chunk, beside the columns in keep (all by default).

    score is called once in each task and returns the function that takes a chunk's texts. New columns
    win over kept ones of the same name.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], fields).schema
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    held = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = held.select(*(f"`{c}`" for c in kept)).schema
    for f in new:
        schema = schema.add(f)
    arrow = {f.name: _arrow(f.dataType.simpleString()) for f in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = score()
        for batch in chunks(batches):
            made = work(texts(batch.column(len(kept))))
            columns = batch.columns[: len(kept)] + [pa.array(made[name], kind) for name, kind in arrow.items()]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *arrow])

    return held.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


class WordRows:
    """Rows of numbers for words, made once per task for each new word; forgets all beyond `most` words."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], most: int = 150_000) -> None:
        self.make, self.most, self.rows = make, most, None
        self.at: dict[bytes, int] = {}

    def indexes(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each document, the row of each word in self.rows (good until the next call)."""
        if len(self.at) > self.most:
            self.at, self.rows = {}, None
        at, new, out = self.at, [], []
        for words in docs:
            for w in set(words).difference(at):
                at[w] = len(at)
                new.append(w)
            out.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
        if new or self.rows is None:
            made = self.make(new)
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
        return out


def bounded_sample(rows: DataFrame, id_col: str, by: str, most: int) -> DataFrame:
    """(id, by) of at most `most` rows for each value of by, the first by a hash of the id; nulls of either are left out.

    One narrow scan counts the values, one more keeps what is sure to hold the first `most` of each; only that is sorted.
    The counts, a row for each value, are broadcast: whoever learns from the sample holds more than that of each value.
    """
    named = rows.select(F.col(id_col).alias("__i"), F.col(by).alias("__v")).where("__i IS NOT NULL AND __v IS NOT NULL")
    counts = named.groupBy("__v").agg(F.count("*").alias("__n"))
    drawn = F.xxhash64(F.lit(11), "__i")
    share = (drawn.cast("double") / 2.0**64 + 0.5) * F.col("__n")
    near = named.join(F.broadcast(counts), "__v").where(share <= most + 7 * most**0.5 + 50)
    first = F.row_number().over(Window.partitionBy("__v").orderBy(drawn, "__i"))
    return near.withColumn("__at", first).where(F.col("__at") <= most).select(F.col("__i").alias(id_col), F.col("__v").alias(by))
