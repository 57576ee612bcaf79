import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import queries, repeats
from tessella.llm.repeats import remove_repeats

SCHEMA = "doc_id long, text string, shard string, spans string"


def brute(texts, least=400):
    """Each document's covered bytes, from a count of all strings of that size."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def held(spark, texts, parts=3):
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in remove_repeats(rows).collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé ", k=rng.randint(2, 8))) for _ in range(n))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 20_000)
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (40, 70, 90, 120, 300)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 400, "c" * 400, "d" * 900, "ab" * 700, "xyz " * 300]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared).encode()
            a = rng.randint(0, 80)
            parts += [s[a : rng.choice([len(s), 380 + a, 400 + a, 405 + a, 650 + a])].decode("utf-8", "ignore"), prose(rng, rng.choice([0, 1, 5, 60]))]
        texts.append("".join(parts))
    base = prose(rng, 500)
    for k in range(12):  # near copies
        x = list(base)
        for _ in range(k):
            x[rng.randrange(len(x))] = "#"
        texts.append("".join(x))
    want = brute(texts)
    assert sum(w[1] > 0 for w in want) > 30
    assert held(spark, texts) == want


def test_edges_of_exactly_the_least_size(spark):
    rng = random.Random(2)
    core = "".join(rng.choices("abcdefgh", k=400))
    texts = [f"1{core}2", f"3{core}4", f"5{core[:399]}6", f"7{core[1:]}8"]
    got = held(spark, texts, 1)
    assert [g[1] for g in got] == [400, 400, 0, 0]
    assert got == brute(texts)


def test_spans_and_kept_bytes(spark):
    core = "".join(random.Random(3).choices("abcdefgh", k=500))
    rows = spark.createDataFrame([(1, "é" + core + "end", None, None), (1, core, None, None), (None, core + "z", None, None)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in remove_repeats(rows, with_kept=True).collect()))
    assert got == [(0, 501, [(0, 500)], b"z"), (1, 500, [(0, 500)], b""), (1, 505, [(2, 502)], "éend".encode())]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_too_short_for_the_places(spark):
    with pytest.raises(ValueError, match="SPAN"):
        remove_repeats(spark.createDataFrame([], SCHEMA), least=100)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op13_repeated_strings(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == brute([d.text for d in docs])
