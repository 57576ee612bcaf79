"""Whitening of embeddings by their leading principal components, without ever holding a covariance matrix.

Vectors are read as integers, so sums and squared deviations are exact. The fit list is each distinct vector once. A pass
sends a block of directions to the tasks, which centre their rows, multiply and add up X'(X v) by dimension; Spark adds
the tasks' sums, so the driver gets one row for each dimension. Block Lanczos grows an orthonormal basis from these
passes, orthogonalised against all of it twice; columns that break down are replaced by new random ones; it ends when
the residuals of the wanted components are at rounding or the basis spans the space. The trace, from the exact
deviations, gives each component's share.

Defined results: rows whose vector is null, empty or holds a null, NaN, infinite or enormous entry (64 times it past 2^62)
have no result, nor have rows whose length is not the most frequent one (the longest of those tied). Components of no
variance cannot be whitened and are left out, so that a table of one distinct vector, or an empty one, gives an empty
table. Repeated vectors count once in the fit and are all whitened; null and equal ids are kept apart. Equal eigenvalues have
any orthonormal components of their space, the same for all rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize

#: Steps to a unit, and what is added so that common entries are positive.
SCALE, SHIFT = 64, 1_000_000
#: Directions sent at once beyond the wanted ones, and the residual, of the largest eigenvalue, at which to stop.
MORE, RESIDUAL = 8, 1e-14
#: Least eigenvalue, of the largest, that can be whitened.
LEAST = 1e-13


@dataclass
class Whitening:
    """What a fit learned: how many vectors, the exact sums of each dimension, components as columns, and their measures."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(docs: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """keep and x, the vector's entries as long; only rows whose vectors are whole."""
    value = F.col(f"`{vector_col}`")
    whole = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**62 / SCALE))
    rows = docs.where(value.isNotNull() & (F.size(value) > 0)).where(whole)
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.transform(value, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centred:
    """n * x - S for each dimension, exact while it fits in 64 bits."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.middle = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        apart = x - self.middle
        if len(apart) and int(np.abs(apart).max()) >= (1 << 62) // self.n:
            return apart.astype(object) * self.n - self.rest
        return apart * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        far = self.exact(x)
        if far.dtype != object and (not len(far) or float(np.abs(far).max()) ** 2 * far.shape[1] < 2.0**62):
            return (far * far).sum(axis=1).tolist()
        far = far.astype(object)
        return (far * far).sum(axis=1).tolist()


def _added(fit: DataFrame, d: int, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what work makes of them (rows by dimensions), added by Spark; comes back as a small matrix."""
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(_matrix(batch, "x", d))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["at", *names])

    parts = fit.select("x").mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names))
    rows = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).collect()
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric matrix that is only known by its products with blocks."""
    rng, width = np.random.default_rng(seed), min(d, k + MORE)

    def fresh(basis: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
        """n orthonormal columns outside the basis: the block's own directions first, random ones where it breaks down."""
        out = np.empty((d, 0))
        scale = np.linalg.norm(block) or 1.0
        while out.shape[1] < n:
            held = np.hstack([basis, out])
            for _ in range(2):
                block = block - held @ (held.T @ block)
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-12 * scale][:, : n - out.shape[1]]
            for _ in range(2):
                u = u - held @ (held.T @ u)
                u = np.linalg.qr(u)[0]
            out = np.hstack([out, u])
            block, scale = rng.standard_normal((d, n - out.shape[1])), np.sqrt(d)
        return out

    basis, images = np.empty((d, 0)), np.empty((d, 0))
    block = rng.standard_normal((d, width))
    while True:
        block = fresh(basis, block, min(width, d - basis.shape[1]))
        image = times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        found = basis @ vectors
        left = np.linalg.norm(images @ vectors - found * values, axis=0)
        if basis.shape[1] == d or (left <= RESIDUAL * values[0]).all():
            found = np.linalg.qr(found)[0]
            return values, found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(k)])
        block = image


def fit_whitening(docs: DataFrame, vector_col: str = "embedding", components: int = 16) -> Whitening | None:
    """Learns from each distinct whole vector once; None where nothing varies."""
    rows = integers(docs, vector_col)
    d = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not d:
        return None
    d = d[0].d
    fit = materialize(rows.where(F.size("x") == d).distinct())
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    n, sums = sums[0].n, [int(r.s) for r in sums]
    centre = Centred(n, sums)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(centre.deviations(_matrix(b, "x", d))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["v"])

    total = fit.mapInArrow(spread, "v string").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect()[0][0]
    if not total:
        discard(fit)
        return None
    trace = float(total) / n / n / n

    def times(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centre.rows(x)
            return c.T @ (c @ block)

        return _added(fit, d, block.shape[1], work) / n

    values, vectors = lanczos(times, d, min(components, d))
    able = values > LEAST * values[0]
    values, vectors = values[able], vectors[:, able]
    scaled = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centre.rows(x) @ scaled
        return np.vstack([y.T @ y, y.sum(axis=0)])

    made = _added(fit, d, len(values), moments) / n
    off = made[:-1] - np.outer(made[-1], made[-1]) - np.eye(len(values))
    discard(fit)
    return Whitening(n, sums, vectors, values, values / trace, float(np.abs(off).max()))


def whiten(docs: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per whole vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(docs, vector_col, id_col).withColumnRenamed(id_col, "id")
    kind = rows.schema["id"].dataType.simpleString()
    d = len(model.sums) if model else 0
    centre = Centred(model.n, model.sums) if model else None
    scaled = model.components / np.sqrt(model.eigenvalues) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", d)
                made = centre.rows(x) @ scaled
                of = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(str, centre.deviations(x)), pa.string()), of], ["id", "deviation", "made"])

    made = rows.where(F.size("x") == d).mapInArrow(run, f"id {kind}, deviation string, made array<double>")
    one = made.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("made").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(v)) for v in (model.explained if model else []))).cast("array<double>")
    return one.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
