"""Token counts by section, from one encoding of each whole document.

A document is its fields in order, joined by line feeds, and is encoded once. Token lengths in bytes add up to each
token's span; spans are joined to the sections' intervals. A separator belongs to the section before it. A token that
crosses a boundary goes to the section that holds most of its bytes, to the earlier one if they hold as many.

Sections: each field; a text field counts its first line as `<field>.head` and the rest as `<field>.body`.

Spans are in bytes, as a token may end inside a character.

Defined results: a null or empty field has no bytes of its own and may have no tokens; each document gives a row for
each section, in order. Bytes that are no UTF-8 are left out before encoding and not counted. Repeated ids are counted
row by row. Very long texts are encoded whole. Ties of a crossing token: the earlier section. An empty table gives an
empty table. Columns that are no fields are not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import chunks, texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str = RANKS) -> bytes:
    """The tokenizer's file as bytes, to be sent to the tasks; it is about a megabyte, as its vocabulary is fixed."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("tokens", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for piece, k in table.items():
            self.size[k] = len(piece)

    def count(self, fields: Sequence[bytes], split: Sequence[bool]) -> list[tuple[int, int, int]]:
        """(bytes, tokens, of them crossing a boundary) of each section."""
        fields = [f.decode("utf-8", "ignore").encode() for f in fields]
        parts = []
        for k, (field, cut) in enumerate(zip(fields, split, strict=True)):
            whole = field + b"\n" * (k + 1 < len(fields))
            at = field.find(b"\n") + 1 if cut else 0
            parts += [whole[:at], whole[at:]] if cut and at else [whole, b""] if cut else [whole]
        ends = np.cumsum([len(p) for p in parts])
        ids = np.array(self.coder.encode_ordinary(b"".join(parts).decode("utf-8")), np.int64)
        stop = np.cumsum(self.size[ids])
        start = stop - self.size[ids]
        first, last = (np.searchsorted(ends, x, "right") for x in (start, stop - 1))
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            cuts = np.clip(ends[first[i] : last[i] + 1], start[i], stop[i])
            owner[i] = first[i] + int(np.argmax(np.diff(cuts, prepend=start[i])))
        n = np.bincount(owner, minlength=len(parts))
        crossing = np.bincount(owner[first != last], minlength=len(parts))
        return [(len(p), int(a), int(b)) for p, a, b in zip(parts, n, crossing, strict=True)]


def count_tokens(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", fields: Sequence[str] = ("source", "lang", "text"), split: Sequence[str] = ("text",)) -> DataFrame:
    """A row for each document and section: id, section, n_bytes, n_tokens, n_crossing."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [s for f in fields for s in ([f"{f}.head", f"{f}.body"] if f in split else [f])]
    cut = [f in split for f in fields]
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), *(F.col(f"`{f}`").cast("string").alias(f"__{k}") for k, f in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chunks(batches):
            made = [x for row in zip(*(texts(c) for c in batch.columns[1:]), strict=True) for x in encoder.count(row, cut)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
            counts = [pa.array([x[k] for x in made], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(names * batch.num_rows), *counts], ["__id", "section", "n_bytes", "n_tokens", "n_crossing"])

    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("section", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_crossing")])
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
