"""Removal of long byte strings that occur more than once, from sorted shards of suffixes merged in rounds.

A shard is a run of documents of about SHARD bytes. Its suffixes are taken at content-chosen places (the smallest
hash of GRAM bytes in each SPAN places in a row), so that every string of `least` bytes owns one place inside itself and all
its copies own the same one. Each shard sorts what stands at its places once and posts its runs: equal prefixes, with
how often they stand there, never single suffixes. The merge interleaves the shards' runs by key and refines the
blocks in rounds, as merging Burrows-Wheeler transforms does, but many symbols a round:

1. runs meet on the prefix that all windows of a place share; a block with one suffix in all shards has no repeat
   (its common prefix is too short) and is never looked at again;
2. within a block, runs that also agree on everything their windows cover, to the left and to the right, are repeated
   as a whole; a block in which each run found its twin is done;
3. blocks left over go back to their shards, which cut the windows of each place into cells and post those; the last
   round's cells are single windows, for which the shared prefix is the window itself.

Only blocks still open reach the next round, and no shard sorts the suffixes of another. Prefixes are compared by 64-bit
hashes, whole runs by another 62 bits within equal prefixes. The plain refinement by one byte a round would need `least`
rounds over all suffixes.

Defined results: a null text is empty; texts under `least` bytes have no repeat and stay whole; bytes are judged on the
input, not on what is left, so both of two copies lose the string; matches may overlap, also within one document, and
never cross documents. Every row is its own document, whatever its id; null and equal ids are kept apart; equal texts
lose all their repeated bytes. One document is one task's work, whole. An empty table gives an empty table. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, materialize

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD = 1 << 20
#: Bytes of the hashes that choose a place, and the most places in a row of which one is chosen.
GRAM, SPAN = 24, 256
#: Windows to a cell, by round; the first round's is SPAN.
CELLS = (SPAN, 16, 1)
#: Two primes under 2^31 for the second hash, with multipliers; fixed, as hashes must agree between runs of a task.
_PRIMES = ((2147483629, 1103515249), (2147483587, 1566083945))
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int, mod: int | None) -> np.ndarray:
    """base^0 .. base^(n - 1), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), mod or 1 << 64)
        more = out * np.uint64(step)
        out = np.concatenate([out, more % np.uint64(mod) if mod else more])
    return out[:n]


class _Tables:
    """Powers and byte values that all shards of a task share; they grow with the longest shard."""

    def __init__(self) -> None:
        self.size, rng = 0, np.random.default_rng(20240229)
        self.values = rng.integers(1, 1 << 62, 256, dtype=np.uint64)

    def need(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, SHARD + SHARD // 2)
            self.wide = _powers(_ODD, self.size, None)
            self.back = _powers(pow(_ODD, -1, 1 << 64), self.size, None)
            self.mods = [(np.uint64(p), _powers(b, self.size, p), _powers(pow(b, -1, p), self.size, p)) for p, b in _PRIMES]


@cache
def _tables() -> _Tables:
    """One for each Python worker."""
    return _Tables()


class Shard:
    """The bytes of some documents and the hashes of any strings of theirs."""

    def __init__(self, docs: list[bytes]) -> None:
        self.text = np.frombuffer(b"".join(docs), np.uint8)
        self.stop = np.cumsum([len(d) for d in docs], dtype=np.int64)
        self.start = self.stop - [len(d) for d in docs]
        n, self.tables = len(self.text), _tables()
        tables = self.tables
        tables.need(n + 1)
        self.mixed = tables.values[self.text]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.mixed * tables.wide[:n], out=self.sums[1:])
        self.second: list[np.ndarray] = []

    def short_key(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """64 bits of the strings of these sizes that start at these places."""
        x = (self.sums[at + size] - self.sums[at]) * self.tables.back[at]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def long_key(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62 bits of the strings between these places, by two primes."""
        if not self.second:
            for p, powers, _ in self.tables.mods:
                sums = np.zeros(len(self.text) + 1, np.uint64)
                np.cumsum(self.mixed % p * powers[: len(self.text)] % p, out=sums[1:])
                self.second.append(sums)
        parts = [(sums[stop] - sums[at]) % p * back[at] % p for sums, (p, _, back) in zip(self.second, self.tables.mods, strict=True)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def places(self, least: int) -> np.ndarray:
        """(first window, last window, place) as rows: each window's start belongs to one place, chosen by the window's own bytes."""
        n, last = len(self.text), self.stop - least
        if n < least or not (last >= self.start).any():
            return np.empty((0, 3), np.int64)
        grams = self.short_key(np.arange(n - GRAM + 1), GRAM)
        # Ties go to the earlier place, which copies share.
        ranked = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(len(grams), dtype=np.uint64) % np.uint64(1 << 28)
        pad = -len(ranked) % SPAN + SPAN
        blocks = np.concatenate([ranked, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(self.start, last, strict=True) if b >= a])
        chosen = (np.minimum(behind[starts], ahead[starts + SPAN - 1]) & np.uint64((1 << 28) - 1)).astype(np.int64)
        chosen += starts >> 28 << 28
        chosen += (chosen < starts).astype(np.int64) << 28
        new = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        return np.stack([starts[new], starts[np.append(new[1:], len(starts)) - 1], chosen[new]], axis=1)

    def keys(self, nodes: np.ndarray, cell: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The prefix that all windows of a node's cell share, and all that the node's windows cover."""
        first, last, place = nodes.T
        return self.short_key(place - (place - last) // cell * cell, least - cell + 1).view(np.int64), self.long_key(first, last + least).view(np.int64)


def cells(nodes: np.ndarray, cell: int) -> np.ndarray:
    """Nodes cut where a window's distance to its place is a multiple of the cell."""
    first, last, place = nodes.T
    low, high = (place - last) // cell, (place - first) // cell
    n = high - low + 1
    of = np.repeat(np.arange(len(nodes)), n)
    at = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    near, far = np.maximum(place[of] - last[of], at * cell), np.minimum(place[of] - first[of], at * cell + cell - 1)
    return np.stack([place[of] - far, place[of] - near, place[of]], axis=1)


def runs_of(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the joined intervals [first, second)."""
    if not len(nodes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes = nodes[np.argsort(nodes[:, 0], kind="stable")]
    stop = np.maximum.accumulate(nodes[:, 1])
    new = np.append(True, nodes[1:, 0] > stop[:-1])
    return nodes[new, 0], stop[np.append(np.flatnonzero(new)[1:] - 1, len(nodes) - 1)]


def _schema(id_type: T.DataType) -> T.StructType:
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    own = [("shard", T.LongType()), ("id", id_type), ("text", T.BinaryType()), ("done", T.BinaryType()), ("nodes", T.BinaryType())]
    found = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", span), ("kept_sha256", T.StringType()), ("kept", T.BinaryType())]
    runs = [("prefixes", T.ArrayType(T.LongType())), ("wholes", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(*x) for x in own + found + runs])


def _arrow(schema: T.StructType, id_kind: pa.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([pa.field(f.name, id_kind if f.name == "id" else f.type) for f in to_arrow_schema(schema)])


def _result(text: bytes, spans: np.ndarray, with_kept: bool) -> dict:
    """The last word on a document whose repeated intervals are known."""
    starts, stops = runs_of(spans)
    pieces = [text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)] if len(starts) else [text]
    kept = b"".join(pieces)
    return {
        "n_bytes": len(text), "n_removed": len(text) - len(kept), "spans": [{"start": int(a), "stop": int(b)} for a, b in zip(starts, stops, strict=True)],
        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_kept else None,
    }


def _rows(shard: int, ids: pa.Array, docs: list[bytes], nodes: np.ndarray, spans: list[np.ndarray], data: Shard, cell: int, least: int, with_kept: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A shard after a round: documents with open nodes, results of the others, and one row with the runs of the nodes."""
    owner = np.searchsorted(data.stop, nodes[:, 0], "right")
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    out: dict[str, list] = {f.name: [] for f in schema if f.name != "id"}

    def add(**row) -> None:
        for name, column in out.items():
            column.append(row.get(name))

    for k, text in enumerate(docs):
        if bounds[k] < bounds[k + 1]:
            own = nodes[bounds[k] : bounds[k + 1]] - data.start[k]
            add(shard=shard, text=_pressed(text), done=spans[k].astype(np.int64).tobytes(), nodes=b"" if cell == SPAN else own.astype(np.int64).tobytes())
        else:
            add(**_result(text, spans[k], with_kept))
    if len(nodes):
        prefix, whole = data.keys(nodes, cell, least)
        order = np.lexsort((whole, prefix))
        prefix, whole = prefix[order], whole[order]
        new = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (whole[1:] != whole[:-1])))
        add(shard=shard, prefixes=prefix[new], wholes=whole[new], counts=np.diff(np.append(new, len(prefix))))
        ids = pa.concat_arrays([ids, pa.nulls(1, ids.type)])
    columns = [ids if f.name == "id" else pa.array(out[f.name], f.type) for f in schema]
    batch = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, batch.num_rows, 512):
        yield batch.slice(at, 512)


def _sort_shards(docs: DataFrame, least: int, with_kept: bool, schema: T.StructType) -> DataFrame:
    """Round 1's shards: each reads its documents whole and posts the sorted runs of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def close(ids: list[pa.Array], held: list[bytes]) -> Iterator[pa.RecordBatch]:
            data = Shard(held)
            none = [np.empty((0, 2), np.int64)] * len(held)
            yield from _rows(secrets.randbits(62), pa.concat_arrays(ids), held, data.places(least), none, data, SPAN, least, with_kept, _arrow(schema, kind))

        ids: list[pa.Array] = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                if held and size + len(text) > SHARD:
                    yield from close(ids, held)
                    ids, held, size = [], [], 0
                ids.append(batch.column(0).slice(k, 1))
                held.append(text)
                size += len(text)
        if held:
            yield from close(ids, held)

    return docs.mapInArrow(run, schema)


def _pressed(text: bytes) -> bytes:
    """A text as it waits for the next round: its length, then its bytes by zstd."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpressed(held: bytes) -> bytes:
    return pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)


def _merge(shards: DataFrame) -> DataFrame:
    """(shard, prefix, whole, twin, open) of the runs in blocks of two suffixes or more, over all shards.

    twin: the run as a whole stands at two places or more. open: some run of its block has no twin.
    """
    runs = shards.where("prefixes IS NOT NULL").select("shard", F.explode(F.arrays_zip("prefixes", "wholes", "counts")).alias("r"))
    runs = runs.select("shard", F.col("r.prefixes").alias("prefix"), F.col("r.wholes").alias("whole"), F.col("r.counts").alias("n"))
    blocks = runs.groupBy("prefix").agg(F.sum("n").alias("size")).where("size > 1").select("prefix")
    live = materialize(runs.join(blocks, "prefix"))
    each = live.groupBy("prefix", "whole").agg(F.sum("n").alias("n"))
    # Written down, so that the join below is one of two plain exchanges, of which Spark splits a block with very many runs.
    least = materialize(each.groupBy("prefix").agg((F.min("n") == 1).alias("open")))
    marks = materialize(live.select("shard", "prefix", "whole").join(each, ["prefix", "whole"]).join(least, "prefix").select("shard", "prefix", "whole", (F.col("n") > 1).alias("twin"), "open"))
    discard(live)
    discard(least)
    return marks


def _refine(shards: DataFrame, marks: DataFrame, round_: int, least: int, with_kept: bool, schema: T.StructType) -> DataFrame:
    """The shards after a round: intervals of runs with a twin are done, nodes of open blocks are cut into the next cells."""
    cell, following = CELLS[round_], CELLS[round_ + 1] if round_ + 1 < len(CELLS) else 0

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _arrow(schema, left.schema.field("id").type)
        if not left.num_rows:
            return out.empty_table()
        docs = [_unpressed(x) for x in left.column("text").to_pylist()]
        data = Shard(docs)
        if round_:
            nodes = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) + a for x, a in zip(left.column("nodes").to_pylist(), data.start, strict=True)])
        else:
            nodes = data.places(least)
        spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in left.column("done").to_pylist()]
        prefix, whole = data.keys(nodes, cell, least)
        marked, twin, opened = right.column("whole").to_numpy(), right.column("twin").to_numpy(), right.column("open").to_numpy()
        order = np.lexsort((right.column("prefix").to_numpy(), marked))
        marked, twin, opened, at = marked[order], twin[order], opened[order], right.column("prefix").to_numpy()[order]
        both, mine = (np.rec.fromarrays(x, names="whole,prefix") for x in ((marked, at), (whole, prefix)))
        found = np.minimum(np.searchsorted(both, mine), max(len(marked) - 1, 0))
        met = both[found] == mine if len(marked) else np.zeros(len(nodes), bool)
        sure, cut = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
        sure[met], cut[met] = twin[found[met]], opened[found[met]]
        done = np.stack([nodes[sure, 0], nodes[sure, 1] + least], axis=1)
        owner = np.searchsorted(data.stop, done[:, 0], "right")
        bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
        for k in range(len(docs)):
            if bounds[k] < bounds[k + 1]:
                joined = runs_of(np.concatenate([spans[k], done[bounds[k] : bounds[k + 1]] - data.start[k]]))
                spans[k] = np.stack(joined, axis=1)
        nodes = cells(nodes[cut], following) if following else nodes[:0]
        nodes = nodes[np.argsort(nodes[:, 0], kind="stable")]
        ids = pa.concat_arrays(left.column("id").chunks)
        return pa.Table.from_batches(_rows(int(left.column("shard")[0].as_py()), ids, docs, nodes, spans, data, following or 1, least, with_kept, out), out)

    waiting = shards.where("text IS NOT NULL").select("shard", "id", "text", "done", "nodes")
    return waiting.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, with_kept: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, spans (start, stop of the removed runs), kept_sha256, kept (the remaining bytes, if asked for)."""
    if least < GRAM + SPAN:
        raise ValueError(f"strings of less than {GRAM + SPAN} bytes need a smaller SPAN")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = _schema(rows.schema["id"].dataType)
    found = lambda x: x.where("n_bytes IS NOT NULL").select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256", "kept")
    shards, out = materialize(_sort_shards(rows, least, with_kept, schema)), None
    for round_ in range(len(CELLS)):
        ready = materialize(found(shards))
        out = ready if out is None else out.unionByName(ready)
        marks = _merge(shards)
        following = materialize(_refine(shards, marks, round_, least, with_kept, schema))
        discard(marks)
        discard(shards)
        shards = following
    return out.unionByName(found(shards))
