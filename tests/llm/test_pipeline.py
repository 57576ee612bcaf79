import random

import corpus_pipeline
from tessella.llm.common import materialize


def test_stages_take_out_what_they_should_and_nothing_else(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(4000)]
    some = lambda n: rng.choices(vocab, k=n)
    rows, labels = [], []
    add = lambda w, s="s1": rows.append((len(rows), " ".join(w), "en", s, 1, "kept"))
    for i in range(300):
        w = some(rng.randint(60, 150))
        if i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["nastyword", "vileword"])
        labels.append((i, int(i % 6 == 0)))
        add(w, ["s1", "s2", None][i % 3])
    item = some(40)
    planted = {}
    planted["leak"] = len(rows)
    add(some(50) + item + some(30))
    near = rows[1][1].split()
    near[5] = "changed"
    planted["near"] = len(rows)
    add(near)
    planted["exact"] = len(rows)
    add(rows[2][1].split())
    planted["short"] = len(rows)
    add(some(10))
    planted["toxic"] = len(rows)
    add(some(40) + ["vileword"] + some(40))
    rows += [(1000, None, None, None, None, None), (None, " ".join(some(80)), None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, str(tmp_path)))
        assert after.columns == docs.columns
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        gone[name] = ids(docs) - ids(after)
        assert after.join(docs, after.columns, "left_anti").where("doc_id IS NOT NULL").where("text IS NOT NULL").where("source IS NOT NULL").count() == 0
        docs = after
    assert gone["toxicity"] == {i for i, y in labels if y} | {planted["toxic"]}
    assert gone["quality_rules"] == {planted["short"], 1000}
    assert gone["near_dedup"] == {planted["near"], planted["exact"]}
    assert gone["decontamination"] == {planted["leak"]}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.columns == [*docs.columns, "mix_copy"]
    words = sum(len(r.text.split()) for r in docs.collect())
    assert abs(sum(len(r.text.split()) for r in out.collect()) - words) < 3 * 150
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_empty_tables_give_no_rows(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
