"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Each distinct shingle set gets a signature of COORDINATES values, each the shingle with the least hash under one
random function. Two sets at the threshold's Jaccard similarity agree in at least `matches()` coordinates but for a
chance under MISS. Sets are posted under coordinate-value pairs and their collisions counted, with two savings:
  * prefix: pairs are put in one order for all sets, frequent ones last. Sets that agree in `matches()` of their pairs
    share one of the first COORDINATES - matches + 1 of either, so only those are posted: first in an order that puts the
    most frequent ones last, then, for the sets that meet there, by exact counts. What a third of all documents share
    thus makes no list as long as it is less than what two near duplicates share;
  * skip: the long lists behind the prefix are never merged. Each posting that meets another counts the collisions
    in all coordinates at once, from signatures packed to a byte a coordinate (which never count too few).
Pairs with `matches()` collisions are kept, then confirmed on the full sets.

A list may hold a third of all documents, so no list is expanded into all its pairs:
  1. exact copies fold into one node, named by a 128-bit digest of the set;
  2. in each list, nodes are counted against two of its members (stars), others in each list; each node's best
     partner is confirmed first, other pairs only between groups that are still apart;
  3. lists whose nodes these links have joined are skipped. In the others, nodes outside the largest group are
     counted against all of other groups inside the join, which gives out only the pairs with enough collisions
     whose parity bits allow the overlap: two sets differ in at least as many shingles as their bits do, so copies
     edited too far apart meet in no row. Nothing is capped.

Defined results: no words or null text: an empty set, linked with nothing, its own component. Fewer words than a
shingle: the whole sequence is one shingle. Very long texts give large sets, handled whole. Repeated rows and ids: each
row gets the component of its text. A null id takes part; it names a component only if no row of it has an id. Ties of
frequency, partner or representative go to the smaller hash or id. An empty table gives an empty table. Other columns
of docs, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.llm.common import chunks, discard, map_texts, materialize, texts

COORDINATES, MISS = 64, 1e-5
#: Coordinate-value pairs whose frequency orders the prefix (the order changes no result), and pairs counted at once in a task.
FREQUENT, BLOCK = 1 << 17, 1 << 19
#: 64-bit words of a set's parity bits.
PARITY = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """A hash for each n-word shingle in order; with fewer words, one for the whole sequence."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out + np.uint64(n)


def shingle_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(text.translate(_LOWER).split(), n, hashes))


def _signer(n: int) -> Callable:
    draw = np.random.default_rng(20_240_601)
    a = draw.integers(1, 2**32, (COORDINATES, 1), np.uint32) | np.uint32(1)
    b = draw.integers(0, 2**32, (COORDINATES, 1), np.uint32)
    row, at = np.arange(COORDINATES), np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX

    def sign(found: np.ndarray) -> np.ndarray:
        x, low, value = (found >> np.uint64(32)).astype(np.uint32), None, None
        for start in range(0, len(x), 2048):
            part = a * x[None, start : start + 2048] + b
            i = part.argmin(axis=1)
            least, got = part[row, i], found[start + i]
            value = got if low is None else np.where(least < low, got, value)
            low = least if low is None else np.minimum(least, low)
        return ((value ^ at) * _MIX >> np.uint64(32)).astype(np.uint32)

    def start() -> Callable[[list[bytes]], dict]:
        hashes = WordHashes()

        def work(batch: list[bytes]) -> dict:
            sets = [shingle_set(t, n, hashes) for t in batch]
            signs = [sign(s) if len(s) else None for s in sets]
            return {
                "n_shingles": [len(s) for s in sets],
                "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "values": [None if x is None else x.tobytes() for x in signs],
                "packed": [None if x is None else x.astype(np.uint8).view(np.int64) for x in signs],
                "parity": [parity_bits(s) if len(s) else None for s in sets],
            }

        return work

    return start


def parity_bits(found: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of the set's hashes end in k: xor of two counts no more than the sets differ in."""
    odd = np.bincount((found & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def matches(percent: int) -> int:
    """The most coordinates that a pair at the threshold shares but for a chance under MISS."""
    p = percent / 100
    below, k = 0.0, 0
    while (below := below + comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) < MISS:
        k += 1
    return max(1, k)


def components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root), and the table behind it to be discarded, for the nodes of undirected edges (u, v): rounds of large and small stars, each written out.

    Only minima per node are grouped, so a hub's neighbours are never gathered in one place. A round that changes
    nothing is the last.
    """
    now, seen = materialize(edges.where("u <> v")), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        total = Observation()
        kept = small.select("e.*").where("u <> v").distinct().observe(total, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        after = materialize(kept)
        discard(now)
        now = after
        if total.get == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), now
        seen = total.get


def _near_roots(edges: DataFrame) -> DataFrame:
    """(node, root) where root is the least node within two links, taken from the root found three times over.

    Nodes with one root are of one component; most of a component's nodes have one.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    two = materialize(both.join(one.toDF("v", "m"), "v").groupBy("u").agg(F.min("m").alias("root")).withColumnRenamed("u", "node"))
    out = two
    for _ in range(2):
        out = out.join(two.toDF("root", "further"), "root").select("node", F.col("further").alias("root"))
    out = materialize(out)
    discard(two)
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, n: int) -> DataFrame:
    """(node, members) of the given nodes, made again from one document of each."""
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).join(nodes, F.col("rep").eqNullSafe(F.col("of_rep")) & (F.col("text_hash") == F.col("of_hash"))).select("node", "text")

    def run(batches):
        hashes = WordHashes()
        for batch in chunks(batches):
            sets = [shingle_set(t, n, hashes) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "members"])

    return rows.dropDuplicates(["node"]).mapInArrow(run, "node binary, members array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))

    def run(batches):
        for batch in chunks(batches, 64):
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _posts(values: pa.Array) -> np.ndarray:
    """(nodes, COORDINATES): a coordinate and its value's 32 bits in one number."""
    found = np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
    return found | np.arange(COORDINATES, dtype=np.int64) << 32


def _frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate-value pairs that most nodes have, in order, and their counts; all seen once in a block are left out."""

    def run(batches):
        held, n = [], 0
        for batch in chunks(batches, 1024):
            held.append(_posts(batch.column(0)).ravel())
            n += len(held[-1])
            if n >= BLOCK:
                yield give(held)
                held, n = [], 0
        if held:
            yield give(held)

    def give(held):
        value, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value[n > 1]), pa.array(n[n > 1])], ["post", "n"])

    counted = nodes.select("values").mapInArrow(run, "post bigint, n bigint").groupBy("post").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "post").limit(FREQUENT).toArrow().sort_by("post")
    return top["post"].to_numpy(), top["n"].to_numpy()


def _prefixes(nodes: DataFrame, length: int, frequent: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(post, node) for the rarest `length` pairs of each node."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent or (np.zeros(0, np.int64),) * 2)

    def run(batches):
        names, times = shared.value
        for batch in chunks(batches, 1024):
            posts = _posts(batch.column(1))
            known = np.zeros(posts.shape, np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, posts), len(names) - 1)
                known = np.where(names[at] == posts, times[at], 0)
            first = np.take_along_axis(posts, np.lexsort((posts, known))[:, :length], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(first.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(posts)), length)))], ["post", "node"])

    return nodes.select("node", "values").mapInArrow(run, "post bigint, node binary")


def _shared_prefixes(posted: DataFrame, need: int) -> DataFrame:
    """(post, node) of each node's rarest pairs, of (post, node) for all pairs, by exact counts.

    Pairs that one node has collide with nothing, so they stand for nothing behind them in the prefix: a node with m others
    posts the m - need + 1 rarest of them, and none if m < need.
    """
    shared = posted.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    mine = posted.join(shared, "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("all"))
    return mine.where(F.size("all") >= need).select(F.explode(F.slice("all", F.lit(1), F.size("all") - (need - 1))["post"]).alias("post"), "node")


#: A node's size, packed signature and parity bits, as plain columns so that a join's condition compiles to plain arithmetic.
_FACTS = ["size", *(f"packed_{i}" for i in range(COORDINATES // 8)), *(f"parity_{i}" for i in range(PARITY))]


def _facts(end: str = "") -> list[Column]:
    return [F.col(c).alias(f"{c}{end}") for c in _FACTS]


def _collisions(u: str, v: str) -> Column:
    """How many bytes of two packed signatures are equal."""
    differ = F.lit(0)
    for i in range(COORDINATES // 8):
        x = F.col(f"packed_{i}{u}").bitwiseXOR(F.col(f"packed_{i}{v}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        differ = differ + F.bit_count(x)
    return F.lit(COORDINATES) - differ


def _may_link(u: str, v: str, need: int, percent: int) -> Column:
    """Whether sizes, parity bits and collisions allow that two nodes' sets reach the threshold."""
    a, b = F.col(f"size{u}"), F.col(f"size{v}")
    # Sets that reach it differ in (100 - percent) / (100 + percent) of both sizes' sum at most.
    apart = sum((F.bit_count(F.col(f"parity_{i}{u}").bitwiseXOR(F.col(f"parity_{i}{v}"))) for i in range(PARITY)), F.lit(0))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * apart <= (100 - percent) * (a + b)) & (_collisions(u, v) >= need)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, text_hash, n_shingles, component_id (smallest id reachable), representative.

    The representative is the row that stays of its component: the one with the smallest id, of one text.
    """
    need = matches(percent)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    made = "n_shingles bigint, node binary, values binary, packed array<bigint>, parity array<bigint>"
    signed = materialize(map_texts(slim, "text", _signer(ngram), made, ["id", "text_hash"]))
    facts = F.struct(F.col("n_shingles").alias("size"), *(F.col(c)[i].alias(f"{c}_{i}") for c, n in (("packed", COORDINATES // 8), ("parity", PARITY)) for i in range(n)))
    nodes = materialize(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("r"), F.first(facts).alias("is"), F.first("values").alias("values"))
        .select("node", F.col("r.id").alias("of_rep"), F.col("r.text_hash").alias("of_hash"), "is.*", "values")
    )
    posted = _prefixes(nodes, COORDINATES - need + 1, _frequent(nodes))
    met = posted.join(posted.groupBy("post").agg(F.count("*").alias("n")).where("n > 1").select("post"), "post").select("node").distinct()
    met = materialize(nodes.join(met, "node", "left_semi"))
    here = materialize(_shared_prefixes(_prefixes(met, COORDINATES, None), need))

    drawn = F.struct(F.xxhash64("node", "post").alias("k"), "node")
    heads = here.groupBy("post").agg(F.max(drawn).alias("a"), F.min(drawn).alias("b")).select("post", F.explode(F.array("a.node", "b.node")).alias("head"))
    stars = here.join(heads, "post").where("node <> head").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()
    for x in "vu":
        stars = stars.join(met.select(F.col("node").alias(x), *_facts(f"_{x}")), x)
    stars = materialize(stars.where(_may_link("_u", "_v", need, percent)).select("u", "v", _collisions("_u", "_v").alias("n")))

    def sets_of(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return materialize(_sets(docs, id_col, text_col, nodes.select("node", "of_rep", "of_hash").join(used, "node", "left_semi"), ngram))

    sets = sets_of(stars)
    partner = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"), "n")).groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    links = materialize(_confirm(partner.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets, percent))
    near = _near_roots(links)
    apart = stars.select("u", "v")
    for x in "uv":
        apart = apart.join(near.toDF(x, f"root_{x}"), x, "left")
    apart = apart.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    second = materialize(_confirm(apart, sets, percent))
    both = links.unionByName(second)
    near2 = _near_roots(both)

    rooted = here.join(near2, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = rooted.groupBy("post").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("post")
    rest = materialize(rooted.join(still, "post").join(met.select("node", *_FACTS), "node"))
    main = rest.groupBy("post", "root").agg(F.count("*").alias("n")).groupBy("post").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    b = rest.join(main, "post")
    a, b = (b.select("post", "main", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root")), *_facts(f"_{x}")) for x in "ab")
    pairs = a.where("root_a <> main").join(b.drop("main"), "post").where("root_a <> root_b AND (root_b = main OR node_a < node_b)").where(_may_link("_a", "_b", need, percent))
    pairs = pairs.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()
    pairs = materialize(pairs.join(stars, ["u", "v"], "left_anti"))
    left = sets_of(pairs)
    more = materialize(_confirm(pairs, left, percent))
    comp, found = components(both.unionByName(more))

    named = nodes.select("node", "of_rep", "of_hash").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min(F.struct(F.col("of_rep").isNull().alias("none"), "of_rep", "of_hash")).alias("r"))
    of = materialize(named.join(ids, "root").select("node", F.col("r.of_rep").alias("component_id"), F.col("r.of_hash").alias("of_hash")))
    for x in (met, here, stars, sets, links, near, second, near2, rest, pairs, left, more, nodes, found):
        discard(x)
    out = signed.select("id", "text_hash", "n_shingles", "node").join(of, "node", "left")
    empty = F.col("node").isNull()
    return out.select(
        F.col("id").alias(id_col), "text_hash", "n_shingles", F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (empty | (F.col("id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("of_hash")))).alias("representative"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates; of rows equal in id and text, one stays. Columns of any name come through."""
    found = near_duplicates(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", ngram, percent).where("representative")
    mine = materialize(found.groupBy("id", "text_hash").agg(F.count("*").alias("n")))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("of"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"))
    out = held.join(mine, F.col("of").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("text_hash")))
    if mine.where("n > 1").limit(1).count():
        out = out.where("n = 1").unionByName(out.where("n > 1").dropDuplicates(["hash", "of"]))
    return out.select("row.*")
