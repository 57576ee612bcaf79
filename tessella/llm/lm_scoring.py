"""Cross-entropy difference of a target and a background language model (Moore-Lewis selection).

The target model counts the target documents, the background model all others, so no document is in both. Counts of the
larger side are scaled down to the smaller one's number of tokens, so the models are matched in size while every
document is counted. Both share one vocabulary, every word of all documents, which grows with them. A document is
scored with its own counts left out of the model that counted it.

Counts cover every pair of neighbouring words. The WORDS most frequent words are the head: pairs inside it are counted
in tasks into a table that is bounded by the square of the head, and broadcast. Every place of a word outside the head
goes, with the words before and after it, to where all places of that word meet; there the word and its pairs are
counted, and each document gets back a sum of logarithms. A word outside the head has less than a WORDS-th of all
words. Words go in buckets of about PLACES places, places are packed by bucket and the sums come back packed by the
block of documents that they are for. Which words are the head changes no score. Outside it words are told apart by
62-bit hashes. Documents meet the target ids in one sort-merge join before that, at every number of ids.

A document's score is its cross-entropy under the target model minus that under the background model, in nats a
token: the lower, the more like the target.

Smoothing: P(b | a) = (w n(ab) + K p(b)) / (w n(a) + K), p(b) = (w n(b) + 1/2) / (w N + size / 2); n leaves the scored
document out, N is the side's number of tokens, w its scale, size the number of distinct words and CLASSES for words
that no document has.

Defined results: a document without words has no tokens and null entropies and score. Without target documents both
entropies are there, the target's uniform; likewise where all are targets. Repeated ids are scored row by row; a null
id is never a target. Equal frequencies: the first word by bytes. Very long texts are scored whole. An empty table
gives an empty table. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import chunks, discard, materialize, texts

WORDS, CLASSES, K, HELD, PLACES = 1024, 256, 50.0, 200_000, 600_000
_TAIL = 1 << 62


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "ignore").lower().encode().split()


def vocabulary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> tuple[list[bytes], int, int]:
    """The most frequent words of all documents, of equally frequent ones the first by bytes; how many words there are, and places of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in chunks(batches):
            for t in texts(batch.column(0)):
                seen.update(words_of(t))
            if len(seen) > HELD:
                yield give()
                seen.clear()
        yield give()

    counted = materialize(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    head = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    distinct, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    discard(counted)
    return [bytes(r.word) for r in head], distinct, total - sum(r.n for r in head)


class Coder:
    """Numbers of words: their place in the head, or _TAIL and a hash; for tables base stands for all others, start for the text's start."""

    def __init__(self, head: list[bytes]) -> None:
        self.base, self.start = len(head), len(head) + 1
        self.at = {w: i for i, w in enumerate(head)}
        self.known = len(self.at)

    def numbers(self, text: bytes) -> np.ndarray:
        at, out = self.at, []
        if len(at) > self.known + 400_000:
            self.at = at = dict(list(at.items())[: self.known])
        for w in words_of(text):
            k = at.get(w)
            if k is None:
                k = at[w] = int.from_bytes(blake2b(w, digest_size=8).digest()) >> 2 | _TAIL
            out.append(k)
        return np.array(out, np.int64)

    def before(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.start], numbers[:-1]]) if len(numbers) else numbers

    def pairs(self, previous: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places in a table of (base + 2, base + 1)."""
        return np.where(previous >= _TAIL, self.base, previous) * (self.base + 1) + np.where(own >= _TAIL, self.base, own)


def count_pairs(docs: DataFrame, head: list[bytes], target: str, text_col: str = "text") -> list[np.ndarray]:
    """Bigram counts, (base + 2, base + 1), of the target documents and of the others; other words than the head's are one."""
    shape = len(head) + 2, len(head) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = Coder(head), None
        for batch in chunks(batches):
            if total is None:
                total = np.zeros((2, shape[0] * shape[1]), np.int64)
            for t, of_target in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = coder.numbers(t)
                pair, n = np.unique(coder.pairs(coder.before(own), own), return_counts=True)
                total[0 if of_target else 1, pair] += n
        if total is not None:
            found = np.flatnonzero(total.sum(0))
            for i in range(0, len(found), 100_000):
                part = found[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(x[part], pa.int64()) for x in total)], ["pair", "target", "other"])

    found = docs.select(text_col, target).mapInArrow(run, "pair bigint, target bigint, other bigint").groupBy("pair").agg(F.sum("target").alias("target"), F.sum("other").alias("other")).toArrow()
    out = []
    for name in ("target", "other"):
        table = np.zeros(shape[0] * shape[1])
        table[found["pair"].to_numpy()] = found[name].to_numpy()
        out.append(table.reshape(shape))
    return out


class Side:
    """A model: scaled counts of the head's pairs, words before and words, and what one count of a word adds to K p."""

    def __init__(self, counts: np.ndarray, other: np.ndarray, size: int) -> None:
        n, m = counts.sum(), other.sum()
        self.scale = min(1.0, m / n) if n and m else 1.0
        self.pair, self.before, self.word = (self.scale * x for x in (counts.ravel(), counts.sum(1), counts.sum(0)))
        self.unit = K / (self.scale * n + 0.5 * size)


def _head_losses(of: np.ndarray, before: np.ndarray, own: np.ndarray, member: np.ndarray, sides: list[Side], coder: Coder) -> tuple[list[np.ndarray], np.ndarray]:
    """Each document's loss in either model from pairs inside the head and from words before other words; how often a
    document has each place's word. before and own are numbers below base + 2, of the document; member its side."""
    docs, wide = len(member), coder.base + 2
    had = np.bincount(of * wide + before, minlength=docs * wide)[of * wide + before]
    has = np.bincount(of * wide + own, minlength=docs * wide).reshape(docs, wide)
    known, inside = before != coder.base, (before != coder.base) & (own != coder.base)
    pair = before * (coder.base + 1) + own
    _, back, n = np.unique((of * len(sides[0].pair) + pair)[inside], return_inverse=True, return_counts=True)
    out = []
    for k, side in enumerate(sides):
        own_scale = np.where(member == k, side.scale, 0.0)[of]
        loss = np.where(known, np.log(np.maximum(side.before[before] - own_scale * had, 0) + K), 0.0)
        mine, at, scale = own[inside], pair[inside], own_scale[inside]
        prior = side.unit * (np.maximum(side.word[mine] - scale * has[of[inside], mine], 0) + 0.5)
        loss[inside] -= np.log(np.maximum(side.pair[at] - scale * n[back], 0) + prior)
        out.append(np.bincount(of, loss, docs))
    return out, has


#: A word outside the head at one place of a document.
_PLACE = np.dtype([("before", "<i8"), ("doc", "<i4"), ("after", "<i2"), ("had", "<i4")])
_OUTSIDE, _END = -1, -2  # for after: a word outside the head, the text's end
#: __at: a bucket of words, or -1 and a block of documents. __doc: a document's place in the block. __packed: places or sums.
_ROW = "__at bigint, __block bigint, __doc bigint, __packed binary, n_tokens bigint, __t double, __e double"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, one after the other, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns; the first eight bytes tell their length."""
    whole = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little") * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(blob[:8], "little"), 0, []
    for k in kinds:
        out.append(np.frombuffer(whole, k, n, at))
        at += out[-1].nbytes
    return out


def _packed(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + _pack(*columns)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    change = np.zeros(len(sorted_[0]), bool)
    change[:1] = True
    for x in sorted_:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _rows(rows: DataFrame, kept: list[str], shared, buckets: int) -> DataFrame:
    """A row for each document with what the head tells of it, and rows of packed places of words outside the head, by bucket."""
    schema = rows.sparkSession.createDataFrame([], _ROW).schema
    names = [*schema.names, *kept]
    for f in rows.select(*(f"`{c}`" for c in kept)).schema if kept else []:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, sides = shared.value
        coder, seen, block = Coder(head), 0, TaskContext.get().partitionId()
        keys, places, kinds = [], [], []

        def give() -> Iterator[pa.RecordBatch]:
            key, place = np.concatenate(keys), np.concatenate(places)
            order = np.lexsort((key, key % buckets))
            key, place = key[order], place[order]
            starts = np.append(_runs(key % buckets), len(key))
            for i in range(0, len(starts) - 1, 500):
                part = starts[i : i + 501]
                blobs = [_packed(key[a:b], *(place[c][a:b] for c in _PLACE.names)) for a, b in zip(part, part[1:], strict=False)]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(key[part[:-1]] % buckets), pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), *(pa.nulls(n, k) for k in kinds)], names)
            keys.clear()
            places.clear()

        for batch in chunks(batches):
            docs = [coder.numbers(t) for t in texts(batch.column(0))]
            sizes = np.array([len(x) for x in docs])
            own, before = np.concatenate(docs), np.concatenate([coder.before(x) for x in docs])
            after = np.full(len(own), _END, np.int64)
            after[:-1] = np.where(own[1:] >= _TAIL, _OUTSIDE, own[1:])
            after[np.cumsum(sizes)[sizes > 0] - 1] = _END
            of, n = np.repeat(np.arange(len(docs)), sizes), len(docs)
            number, target = seen + np.arange(n), np.array(batch.column(1).to_pylist(), np.int64)
            sums, has = _head_losses(of, np.where(before >= _TAIL, coder.base, before), np.where(own >= _TAIL, coder.base, own), 1 - target, sides, coder)
            kinds = [c.type for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1 - block)), pa.array(np.full(n, block)), pa.array(number), pa.nulls(n, pa.binary()), pa.array(sizes, pa.int64()), *map(pa.array, sums), *batch.columns[2:]], names)
            seen += n
            at = np.flatnonzero(own >= _TAIL)
            place = np.empty(len(at), _PLACE)
            # A document's number in its block, and whether it is a target; how often it has the head's word after this one.
            place["before"], place["doc"], place["after"] = before[at], (number * 2 + target)[of[at]], after[at]
            place["had"] = np.where(after[at] >= 0, has[of[at], np.maximum(after[at], 0)], 0)
            keys.append(own[at])
            places.append(place)
            if sum(map(len, keys)) > HELD * 5:
                yield from give()
        if keys:
            yield from give()

    return rows.mapInArrow(run, schema)


def _numbered(*sorted_: np.ndarray) -> np.ndarray:
    """The number of each value's run."""
    out = np.zeros(len(sorted_[0]), np.int64)
    out[_runs(*sorted_)[1:]] = 1
    return np.cumsum(out)


def _word_losses(key: np.ndarray, doc: np.ndarray, place: np.ndarray, sides: list[Side]) -> list[np.ndarray]:
    """What each place of words outside the head adds to its document's loss in either model.

    All places of a word are there, and a word's places in one document stand together."""
    word, goes_on, to_head = _numbered(key), place["after"] != _END, place["after"] >= 0
    groups = [(word, _numbered(word, doc))]
    for other in (place["before"], place["after"].astype(np.int64)):
        order = np.lexsort((other, word))
        numbers = _numbered(word[order], other[order]), _numbered(word[order], other[order], doc[order])
        back = np.empty((2, len(key)), np.int64)
        back[:, order] = numbers
        groups.append(tuple(back))
    out = []
    for k, side in enumerate(sides):
        member = (place["doc"] & 1) == 1 - k

        def count(group: tuple, of: np.ndarray, side=side, member=member) -> np.ndarray:
            whole, mine = (np.bincount(g, of)[g] for g in group)
            return side.scale * np.where(member, np.maximum(whole - mine, 0), whole)

        prior = side.unit * (count(groups[0], member * 1.0) + 0.5)
        loss = -np.log(count(groups[1], member * 1.0) + prior)
        loss += np.where(goes_on, np.log(count(groups[0], member * goes_on * 1.0) + K), 0)
        after = np.where(to_head, place["after"], 0)
        prior = side.unit * (np.maximum(side.word[after] - np.where(member, side.scale, 0.0) * place["had"], 0) + 0.5)
        out.append(loss - np.where(to_head, np.log(count(groups[2], member * 1.0) + prior), 0))
    return out


def _sums(rows: DataFrame, shared) -> DataFrame:
    """Rows of documents as they are, and for each block packed sums of what its documents' places add; buckets come whole and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, held, made, kinds = shared.value[1], [], [], []

        def bucket() -> None:
            key, block, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, block, place = key[order], block[order], place[order]
            parts = _word_losses(key, block << 32 | (place["doc"] >> 1), place, sides)
            order = np.lexsort((place["doc"], block))
            block, doc = block[order], place["doc"][order] >> 1
            at = _runs(block, doc)
            made.append((block[at], doc[at], *(np.add.reduceat(x[order], at) for x in parts)))
            held.clear()

        def give() -> Iterator[pa.RecordBatch]:
            block, doc, t, e = (np.concatenate(x) for x in zip(*made, strict=True))
            order = np.lexsort((doc, block))
            block, doc, t, e = block[order], doc[order], t[order], e[order]
            at = _runs(block, doc)
            block, doc, t, e = block[at], doc[at], np.add.reduceat(t, at), np.add.reduceat(e, at)
            starts = np.append(_runs(block), len(block))
            blobs = [_packed(doc[a:b], t[a:b], e[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            n, of = len(blobs), block[starts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(-1 - of), pa.array(of), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), *(pa.nulls(n, k) for k in kinds)], names)
            made.clear()

        last = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[7:]]
            docs = batch.filter(batch.column(2).is_valid())
            if docs.num_rows:
                yield docs
            words = batch.filter(batch.column(2).is_null())
            for at, block, blob in zip(words.column(0).to_pylist(), words.column(1).to_pylist(), words.column(3), strict=True):
                if at != last and held:
                    bucket()
                    if sum(len(x[0]) for x in made) > HELD * 10:
                        yield from give()
                last = at
                key, *fields = _unpack(blob.as_py(), "<i8", *(_PLACE[c].str for c in _PLACE.names))
                place = np.empty(len(key), _PLACE)
                for c, x in zip(_PLACE.names, fields, strict=True):
                    place[c] = x
                held.append((key, np.full(len(key), block), place))
        if held:
            bucket()
        if made:
            yield from give()

    names = rows.columns
    return rows.mapInArrow(run, rows.schema)


def _whole(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Each document with its whole sums; a block's rows come together, its documents first and in order."""
    schema = rows.select("n_tokens", "__t", "__e", *(f"`{c}`" for c in kept)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sums = None, [], []

        def give() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(docs).combine_chunks()
            t, e = (table[c].to_numpy().copy() for c in ("__t", "__e"))
            for doc, x, y in sums:
                t[doc] += x
                e[doc] += y
            table = table.select(["n_tokens", *kept]).add_column(1, "__t", pa.array(t)).add_column(2, "__e", pa.array(e))
            yield from table.to_batches(max_chunksize=10_000)
            docs.clear()
            sums.clear()

        for batch in batches:
            blocks = batch.column(1).to_numpy()
            starts = [*_runs(blocks), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if blocks[a] != now and docs:
                    yield from give()
                now, part = blocks[a], batch.slice(a, b - a)
                mine = part.filter(part.column(2).is_valid())
                if mine.num_rows:
                    docs.append(mine)
                sums += [_unpack(blob.as_py(), "<i4", "<f8", "<f8") for blob in part.column(3) if blob.is_valid]
        if docs:
            yield from give()

    return rows.mapInArrow(run, schema)


def score_cross_entropy(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_tokens, target_entropy, background_entropy and score; targets holds the target ids.

    Kept columns go through the shuffles, once for each document."""
    new = ["n_tokens", "target_entropy", "background_entropy", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    head, distinct, others = vocabulary(docs, text_col)
    size = distinct + CLASSES
    marks = targets.select(F.col(id_col).alias("__of")).where("__of IS NOT NULL").distinct().withColumn("__target", F.lit(True)).hint("merge")
    slim = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("__id"), *(f"`{c}`" for c in kept))
    marked = materialize(slim.join(marks, F.col("__id") == F.col("__of"), "left").select("__text", F.coalesce("__target", F.lit(False)).alias("__target"), *(f"`{c}`" for c in kept)))
    target, other = count_pairs(marked, head, "__target", "__text")
    shared = docs.sparkSession.sparkContext.broadcast((head, [Side(target, other, size), Side(other, target, size)]))
    buckets = max(others // PLACES + 1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = _rows(marked, kept, shared, buckets).repartition("__at").sortWithinPartitions("__at", "__block")
    sums = _whole(_sums(made, shared).repartition("__block").sortWithinPartitions("__block", F.col("__doc").asc_nulls_last()), kept)
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    out = sums.select(*(f"`{c}`" for c in kept), "n_tokens", mean("__t").alias("target_entropy"), mean("__e").alias("background_entropy"))
    return out.withColumn("score", F.col("target_entropy") - F.col("background_entropy"))
