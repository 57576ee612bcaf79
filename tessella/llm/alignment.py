"""Alignment of two tokenizers over the same bytes: groups, overlap links and how common each linked pair is.

Each text is encoded whole by both. Token sizes in bytes add up to spans; B's spans, in order, are a static interval
index: two bisections for each token of A give the first and last token of B that it overlaps. A gap between two tokens of
B that no token of A spans is a group boundary.

A pair's count is taken over all documents: blocks of about BLOCK bytes of text post each distinct pair once with its
number of links, the counts are added by pair, and every block gets back what its own pairs count and whether that
is the most of their B token. Links themselves never leave their task; a document keeps its pairs' ranks in its block.

Defined results: a text that is null, empty, no UTF-8, or not rebuilt by the bytes of both encodings has no tokens: zeros
and an empty digest. Every row is its own document, whatever its id; null and equal ids are kept apart. Very long texts
are encoded whole; a longer one than BLOCK is a block of its own. Pairs tied for the most links of a B token all count
as best. An empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, materialize
from tessella.llm.tokens import PATTERN

FOLDER = "/opt/tokenizers"
#: Bytes of text in a block, whose distinct pairs are posted once.
BLOCK = 4 << 20


def read_tokenizers(a: str = f"{FOLDER}/byte_bpe_50k.json", b: str = f"{FOLDER}/piece_bpe_32k.model") -> tuple[bytes, bytes]:
    """Both tokenizers' files, to be sent to the tasks; a few megabytes, as vocabularies are fixed."""
    out = []
    for path in (a, b):
        with open(path, "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both encoders with the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        own, vocab = _byte_level(), json.loads(a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, k in vocab.items():
            self.bytes_a[k] = bytes(own[c] for c in piece) if all(c in own for c in piece) else piece.encode()
        special = {x["id"] for x in json.loads(a).get("added_tokens", ())}
        # Ids are in order of the merges, so they are the ranks that the faster encoder takes; tests hold it against the file's own.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[k]: k for k in vocab.values() if k not in special}, special_tokens={})
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.wide = len(str(most)) + 1
        names = [str(k).encode() for k in range(most)]
        self.digits = np.frombuffer(b"".join(x.ljust(self.wide) for x in names), np.uint8).reshape(-1, self.wide)
        self.n_digits = np.array([len(x) for x in names])
        self.held = np.arange(self.wide) <= self.n_digits[:, None]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A and by B of each text; None where there are no tokens."""
        plain: list[str] = []
        for t in texts:
            try:
                plain.append(t.decode())
            except UnicodeDecodeError:
                plain.append("")
        at = [k for k, t in enumerate(plain) if t]
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        for k in at:
            ids_a, ids_b, whole = self.a.encode_ordinary(" " + plain[k]), self.b.encode(plain[k]), b" " + texts[k]
            if b"".join(map(self.bytes_a.__getitem__, ids_a)) == whole == b"".join(map(self.bytes_b.__getitem__, ids_b)):
                out[k] = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        return out

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups of A's and B's tokens, and the overlapping tokens as indexes of A and of B."""
        stop_a, stop_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        first = np.searchsorted(stop_b, stop_a - self.size_a[a], "right")
        last = np.searchsorted(stop_b - self.size_b[b], stop_a, "left") - 1
        spanned = np.zeros(len(b) + 1, np.int64)
        np.add.at(spanned, first, 1)
        np.add.at(spanned, last, -1)
        group_b = np.concatenate([[0], np.cumsum(np.cumsum(spanned)[: len(b) - 1] == 0)])
        n = last - first + 1
        of_a = np.repeat(np.arange(len(a)), n)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + first[of_a]
        return group_b[first], group_b, of_a, of_b

    def written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: each group's ids of A and of B."""
        n_groups = int(group_b[-1]) + 1
        at_a = np.arange(len(a)) + (np.cumsum(c := np.bincount(group_b, minlength=n_groups)) - c)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(np.bincount(group_a, minlength=n_groups))[group_b]
        ids, side = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        side[at_a], side[at_b] = 2 * group_a, 2 * group_b + 1
        step = np.append(np.diff(side), 0)
        text = self.digits[ids]
        text[np.arange(len(ids)), self.n_digits[ids]] = np.where(step == 0, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
        return text[self.held[ids]].tobytes()[:-1]


def pack(values: np.ndarray) -> bytes:
    """Small numbers in a byte each, others in four more."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.uint32).tobytes()


def unpack(held: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(held, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(held, np.uint32, offset=n)
    return out


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _block_schema(id_type: T.DataType) -> T.StructType:
    kinds = [("block", T.LongType()), ("id", id_type), *((c, T.LongType()) for c in _COUNTS), ("groups_sha256", T.StringType()), ("groups", T.StringType())]
    kinds += [("n_pairs", T.LongType()), ("ranks", T.BinaryType()), ("times", T.BinaryType()), ("pairs", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(*k) for k in kinds])


def _block(pair: Pair, ids: pa.Array, texts: list[bytes], with_groups: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one for each document, and one with its distinct pairs, the most frequent first."""
    out: dict[str, list] = {f.name: [] for f in schema if f.name != "id"}

    def add(**row) -> None:
        for name, column in out.items():
            column.append(row.get(name))

    block, linked, made = secrets.randbits(62), [], []
    for found in (x for at in range(0, len(texts), 64) for x in pair.encode(texts[at : at + 64])):
        if found is None:
            made.append(dict.fromkeys(_COUNTS, 0) | {"groups_sha256": "", "groups": "" if with_groups else None})
            linked.append(np.empty(0, np.int64))
            continue
        a, b = found
        group_a, group_b, of_a, of_b = pair.links(a, b)
        text = pair.written(a, b, group_a, group_b)
        linked.append(a[of_a] * len(pair.bytes_b) + b[of_b])
        made.append({"n_a": len(a), "n_b": len(b), "n_groups": int(group_b[-1]) + 1, "n_links": len(of_a), "groups_sha256": hashlib.sha256(text).hexdigest(), "groups": text.decode() if with_groups else None})
    pairs, inverse, counts = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    inverse, at = rank[inverse], 0
    for row, own in zip(made, linked, strict=True):
        ranks, times = np.unique(inverse[at : at + len(own)], return_counts=True)
        at += len(own)
        add(block=block if len(own) else None, **row, n_pairs=len(ranks), ranks=pack(np.diff(ranks, prepend=0)), times=pack(times))
    if len(pairs):
        add(block=block, pairs=pairs[order], counts=counts[order])
        ids = pa.concat_arrays([ids, pa.nulls(1, ids.type)])
    columns = [ids if f.name == "id" else pa.array(out[f.name], f.type) for f in schema]
    batch = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, batch.num_rows, 512):
        yield batch.slice(at, 512)


def align_tokenizers(docs: DataFrame, tokenizers: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, groups_sha256, groups (as text, if asked for), n_best, count_sum."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = _block_schema(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, fields = Pair(*shared.value), None
        ids: list[pa.Array] = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            fields = pa.schema([pa.field("id", kind) if f.name == "id" else f for f in to_arrow_schema(schema)])
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                if held and size + len(text) > BLOCK:
                    yield from _block(pair, pa.concat_arrays(ids), held, with_groups, fields)
                    ids, held, size = [], [], 0
                ids.append(batch.column(0).slice(k, 1))
                held.append(text)
                size += len(text)
        if held:
            yield from _block(pair, pa.concat_arrays(ids), held, with_groups, fields)

    blocks = materialize(rows.mapInArrow(run, schema))
    posts = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("rank", "p"))
    posts = posts.select("block", "rank", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    n_b = len(Pair(*tokenizers).bytes_b)
    counts = materialize(posts.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % n_b))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = posts.join(known, "pair").select(F.col("block").alias("of"), "rank", "count", "best")

    keep = ["id", *_COUNTS, "groups_sha256", "groups"]
    scored = T.StructType([schema[c] for c in keep] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("rank").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        n_best, total = [], []
        for n, ranks, times in zip(*(left.column(c).to_pylist() for c in ("n_pairs", "ranks", "times")), strict=True):
            ranks, times = np.cumsum(unpack(ranks, n)), unpack(times, n)
            n_best.append(int(times[best[ranks]].sum()))
            total.append(int((count[ranks] * times).sum()))
        return left.select(keep).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    with_tokens = blocks.where("block IS NOT NULL AND n_a IS NOT NULL").select("block", *keep, "n_pairs", "ranks", "times")
    out = with_tokens.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(score, scored)
    without = blocks.where("block IS NULL").select(*keep, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    done = materialize(out)
    discard(counts)
    return done.unionByName(without).withColumnRenamed("id", id_col)
