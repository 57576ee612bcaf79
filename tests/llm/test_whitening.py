import math
import random

import numpy as np
import pytest

from tessella.llm import queries
from tessella.llm.whitening import Centred, fit_whitening, lanczos, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, id string"


def brute(rows, k=16):
    """{(place of the row, component): (n, deviation, |whitened|, explained)} from the whole covariance matrix."""
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in whole]
    fit = [list(t) for t in {tuple(x) for x in xs}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = (centred**2).sum() / n
    out = {}
    for at, x in enumerate(xs):
        far = [n * a - s for a, s in zip(x, sums, strict=True)]
        y = (np.array(far, float) / n) @ vectors / np.sqrt(values)
        for j in range(len(values)):
            out[at, j + 1] = (n, sum(f * f for f in far), abs(y[j]), values[j] / trace)
    return [i for i, _ in whole], out


def compare(got, want, ids):
    assert len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for j, rows in by.items():
        mine = sorted((r.vec_id, int(r.deviation), abs(r.whitened), r.n, r.explained) for r in rows)
        theirs = sorted((ids[at], w[1], w[2], w[0], w[3]) for (at, c), w in want.items() if c == j)
        assert [(a[0], a[1], a[3]) for a in mine] == [(b[0], b[1], b[3]) for b in theirs]
        assert np.allclose([a[2] for a in mine], [b[2] for b in theirs], rtol=1e-7, atol=1e-7)
        assert np.allclose([a[4] for a in mine], [b[4] for b in theirs], rtol=1e-9)
    # Signs may differ from the brute force, but are one for all rows of a component.


@pytest.mark.parametrize("d", [3, 16, 40])
def test_matches_the_whole_matrix(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((300, d)) * np.linspace(3, 0.5, d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    docs = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(5)
    ids, want = brute(rows)
    model = fit_whitening(docs)
    got = whiten(docs, model).collect()
    compare(got, want, ids)
    assert model.n == 300 and model.identity_error < 1e-8 and {r.identity_error for r in got} == {model.identity_error}


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.random() for _ in range(4)]) for i in range(30)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [1.0, math.nan, 2.0, 3.0]), (94, [1.0, math.inf, 2.0, 3.0]), (95, [1.0, 2.0]), (None, good[0][1]), (96, [3e38, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, None, None) for i, v in good + odd], SCHEMA)
    got = whiten(docs, fit_whitening(docs)).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good} | {None}
    first, copy = ([r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i] for i in (0, None))
    assert first == copy and len(first) == 4


def test_nothing_varies(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], None, None) for i in range(5)], SCHEMA)
    assert whiten(one, fit_whitening(one)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0], None, None) for i in range(5)], SCHEMA)
    assert {r.component for r in whiten(flat, fit_whitening(flat)).collect()} == {1}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whiten(none, fit_whitening(none)).collect() == []


def test_lanczos_ends_early_and_restarts():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = np.concatenate([np.linspace(100, 50, 20), np.full(380, 1e-3)])
    asked = []

    def times(block):
        asked.append(block.shape[1])
        return q @ (values[:, None] * (q.T @ block))

    got, vectors = lanczos(times, 400, 16)
    assert np.allclose(got, values[:16]) and np.allclose(np.abs(np.sum(vectors * q[:, :16], axis=0)), 1) and sum(asked) < 200
    few = np.zeros((50, 50))
    few[0, 0], few[1, 1] = 3, 2
    got, _ = lanczos(lambda b: few @ b, 50, 4)
    assert np.allclose(got, [3, 2, 0, 0])


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 5]], np.int64)
    n, sums = 1 << 30, [7, 11]
    want = sum((n * int(a) - s) ** 2 for a, s in zip(x[0], sums, strict=True))
    assert Centred(n, sums).deviations(x) == [want]


def test_query_matches_the_whole_matrix(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, want = brute(rows)
    out = queries.op12_embedding_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(out.collect(), want, ids)
