"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items are partitioned by their number of shingles, each part up to twice the size of the one before. A long document
is searched, for a part whose largest item has up to u shingles, in windows of 2u shingles that start every u: any run
of u shingles lies in one window, so an item's containment in the document becomes a similarity to a window of about
its own size that signatures can see. An item is a candidate where it and a window agree in one of COORDINATES
minima. Items of less than LEAST shingles are too small for that: every shingle of theirs is looked up, so what a
document holds of them is counted exactly. Window minima of a part are merged from those of the part before. Each candidate is verified on full sets:
distinct item shingles that the whole document holds, of all the item's.

Items are a stated query set: they go to the tasks in blocks of at most BLOCK items, every block against all
documents. N items are N / BLOCK blocks, each one reading of the documents; a benchmark of 100,000 items is 40 of them.

Words are runs of letters and digits in lower case. Defined results: an item with fewer words than a shingle is one
shingle of its own length and found as a run of its words; null or empty items match nothing; null and empty
documents hold nothing. Repeated documents and items are searched row by row; ids may be of any type and null. Very long
texts are searched whole. A share on the threshold counts as contained. An empty table on either side gives no
pairs and drops nothing. Other columns, whatever their names, come through drop_contaminated as they were.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from tessella.llm.common import chunks, texts
from tessella.llm.neardup import WordHashes, shingle_hashes

NGRAM, PERCENT, COORDINATES, LEAST, BLOCK = 5, 80, 32, 16, 5000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_DRAW = np.random.default_rng(77)
_A = _DRAW.integers(1, 2**32, (COORDINATES, 1), np.uint32) | np.uint32(1)
_B = _DRAW.integers(0, 2**32, (COORDINATES, 1), np.uint32)


def _minima(hashes: np.ndarray, size: int) -> np.ndarray:
    """(COORDINATES, blocks): the least value of each coordinate in each block of size hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = []
    for start in range(0, len(x), 256 * size):
        part = x[start : start + 256 * size]
        out.append(np.minimum.reduceat(_A * part + _B, np.arange(0, len(part), size), axis=1))
    return np.concatenate(out, axis=1)


class Items:
    """A block of items: full sets, and for each size part which signature values they have."""

    def __init__(self, rows: list[tuple[int, str]], n: int) -> None:
        hashes = WordHashes()
        self.n, self.ids, self.sets, self.short = n, [], [], defaultdict(dict)
        parts, few = defaultdict(list), defaultdict(list)
        for item, text in rows:
            words = (text or "").encode("utf-8", "ignore").translate(_WORDS).split()
            if not words:
                continue
            found = np.unique(shingle_hashes(words, n, hashes))
            k = len(self.ids)
            self.ids.append(item)
            self.sets.append(found)
            if len(words) < n:
                self.short[len(words)].setdefault(int(found[0]), []).append(k)
            elif len(found) < LEAST:
                for v in found.tolist():
                    few[v].append(k)
            else:
                size = LEAST
                while size < len(found):
                    size *= 2
                parts[size].append(k)
        self.few, self.few_values = few, np.array(sorted(few), np.uint64)
        self.parts = {}
        for size in sorted(parts):
            sign = np.stack([_minima(self.sets[k], len(self.sets[k]))[:, 0] for k in parts[size]], axis=1)
            values = np.unique(sign.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[:, None])
            holders = defaultdict(list)
            for j, k in enumerate(parts[size]):
                for c in range(COORDINATES):
                    holders[int(sign[c, j]) | c << 32].append(k)
            self.parts[size] = values, holders

    def find(self, words: list[bytes], hashes: WordHashes, percent: int) -> list[tuple[int, int, int]]:
        """(item, shingles of it held, shingles of it) of each item that a document contains."""
        out = []
        for length, at in self.short.items():
            if len(words) >= length:
                held = set(shingle_hashes(words, length, hashes).tolist()) & at.keys()
                out += [(self.ids[k], 1, 1) for h in held for k in at[h]]
        if len(words) < self.n or not (self.parts or self.few):
            return out
        found = shingle_hashes(words, self.n, hashes)
        if self.few:
            at = np.minimum(np.searchsorted(self.few_values, found), len(self.few_values) - 1)
            times = Counter(k for v in set(found[self.few_values[at] == found].tolist()) for k in self.few[v])
            out += [(self.ids[k], have, len(self.sets[k])) for k, have in sorted(times.items()) if 100 * have >= percent * len(self.sets[k])]
        if not self.parts:
            return out
        candidates, size = set(), LEAST
        low = _minima(found, size)
        tag = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[:, None]
        for part, (values, holders) in self.parts.items():
            while size < part:
                low = np.minimum(low[:, ::2], np.concatenate([low[:, 1::2], low[:, -1:]], axis=1) if low.shape[1] % 2 else low[:, 1::2])
                size *= 2
            window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
            key = (window.astype(np.uint64) | tag).ravel()
            at = np.minimum(np.searchsorted(values, key), len(values) - 1)
            for v in set(key[values[at] == key].tolist()):
                candidates.update(holders[v])
        if candidates:
            full = np.unique(found)
            for k in sorted(candidates):
                have = int(np.isin(self.sets[k], full, assume_unique=True).sum())
                if 100 * have >= percent * len(self.sets[k]):
                    out.append((self.ids[k], have, len(self.sets[k])))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[Items]:
    """The items in blocks small enough for the driver and each task."""
    total = items.count()
    blocks = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    turn = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))
    for k in range(blocks):
        rows = items.where(turn == k).select(id_col, text_col).collect()
        yield Items([(r[0], r[1]) for r in sorted(rows, key=lambda r: (str(r[0]), r[1] or ""))], n)


def _search(shared, n: int, percent: int) -> Callable[[list[bytes]], list[list[tuple[int, int, int]]]]:
    hashes = WordHashes()
    return lambda batch: [shared.value.find(t.translate(_WORDS).split(), hashes, percent) for t in batch]


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """A row for each document and item that it contains: id, item, shingles held and of the item."""
    out, of = None, items.schema[item_col].dataType
    kind = to_arrow_type(of)
    for block in _blocks(items, item_col, item_text, n):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = _search(shared, n, percent)
            for batch in chunks(batches):
                rows = [(i, *x) for i, found in enumerate(search(texts(batch.column(1)))) for x in found]
                if rows:
                    at, item, held, whole = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, kind), *(pa.array(x, pa.int64()) for x in (held, whole))], [id_col, "__item", "n_held", "n_item"])

        rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
        made = rows.mapInArrow(run, rows.select(id_col).schema.add("__item", of).add("n_held", LongType()).add("n_item", LongType()))
        out = made if out is None else out.unionByName(made)
    return out.withColumnRenamed("__item", item_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that contain no item; texts are not shuffled."""
    out = docs
    for block in _blocks(items, item_col, item_text, n):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        held = out.select(*(f"`{c}`" for c in docs.columns), F.col(f"`{text_col}`").cast("string").alias("__searched"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = _search(shared, n, percent)
            for batch in chunks(batches):
                clean = [not found for found in search(texts(batch.column(batch.num_columns - 1)))]
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(clean, pa.bool_()))

        out = held.mapInArrow(run, docs.schema)
    return out
