import pytest

from tessella.llm.mixing import mix, mixed, targets

SCHEMA = "doc_id long, text string, source string, size string, source_size int"


def filled(sizes, weights, most):
    """Targets by pouring what capped sources leave, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, cap, out = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {s: most * n for s, n in sizes.items()}, {}
    left = sum(sizes.values())
    while True:
        rest = [s for s in order if s not in out]
        level = left / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if cap[s] < level * weight[s]]
        if not over:
            return out | {s: level * weight[s] for s in rest}
        for s in over:
            out[s] = float(cap[s])
            left -= cap[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 300, None: 70}, {"x": 4}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 10_000, "Z": 3, "é": 7}])
def test_targets_pour_over(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in rows} == filled(sizes, (1, 2, 3), 3)


def test_epochs_come_first_and_budgets_are_met(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)) + " #" * (i % 3), ["big", "mid", "small", None][0 if i % 3 else i % 4], "x", 1) for i in range(900)]
    rows += [(5000, None, "mid", None, None), (5001, "", "mid", None, None), (None, "a b", "mid", None, None), (5002, "a b c", None, None, None), (5002, "a b c", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    for source in {r[2] for r in rows}:
        mine = [r for r in got if r.source == source]
        whole, target = sum(r["__size"] for r in mine), mine[0]["__target"]
        assert {r["__source_size"] for r in mine} == {whole}
        assert {r["__copies"] - target // whole for r in mine} <= {0, 1}
        assert abs(sum(r["__taken"] for r in mine) - target) <= max(r["__size"] for r in mine)
        assert all(r["__taken"] <= 3 * r["__size"] for r in mine)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixed(docs)
    assert out.columns == [*docs.columns, "mix_copy"]
    assert out.count() == sum(r["__copies"] for r in got)
    assert mix(docs.limit(0)).count() == mixed(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    clean = [(i, "word " * 10, "a", None, None) for i in range(400)]
    noisy = [(i, "w### " * 10, "a", None, None) for i in range(400, 800)]
    got = mix(spark.createDataFrame(clean + noisy, SCHEMA), share=0.5).where("__copies > 0").collect()
    assert sum(r.doc_id < 400 for r in got) > 2 * sum(r.doc_id >= 400 for r in got)
