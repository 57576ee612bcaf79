import itertools
import random

import numpy as np
import pytest

from tessella.llm.neardup import drop_near_duplicates, near_duplicates, parity_bits

SCHEMA = "doc_id long, text string, lang string, root string"


def brute(rows, n, percent):
    """Components over all pairs of full sets."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    return sets, [min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in group]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(spark, n, percent):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(words, k=rng.randint(5, 120)) for _ in range(25)]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, (" \n".join if i % 2 else "\t".join)(w).upper() if i % 3 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE "), (1005, "one two"), (1006, "word " * 30_000)]
    sets, want = brute(rows, n, percent)
    got = near_duplicates(spark.createDataFrame([(i, t, None, "x") for i, t in rows], SCHEMA), ngram=n, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.representative) for r in got} == {(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, want, strict=True)}
    assert len(got) == len(rows)


def test_ids_may_be_null_or_repeat_and_tables_empty(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, text), (7, text), (7, text), (8, None), (None, None), (9, "x y z q r s")]
    docs = spark.createDataFrame([(i, t, "en", "r") for i, t in rows], SCHEMA)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, text), (8, None), (None, None), (9, "x y z q r s")], key=str)
    assert drop_near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(docs.limit(0)).count() == 0


def test_parity_bits_never_count_more_than_the_sets_differ_in():
    rng = np.random.default_rng(4)
    for size, moved in ((0, 3), (40, 0), (40, 9), (300, 30), (20_000, 15_000)):
        a = np.unique(rng.integers(0, 2**63, size, np.uint64))
        b = np.unique(np.concatenate([a[moved:], rng.integers(0, 2**63, moved, np.uint64)]))
        bits = sum(int(x).bit_count() for x in (parity_bits(a) ^ parity_bits(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
        assert bits or not moved
