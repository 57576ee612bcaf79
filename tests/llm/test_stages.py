"""Pipeline stages on tables that are hard on them: clashing column names, labels that teach nothing."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import toxicity

CLASH = ["__id", "__of", "__copies", "__toxicity", "__size", "__taken", "__row_hash", "__hash", "__rows", "row", "id", "score", "text_hash", "hash", "n", "of", "of_source"]


def tables(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "an item of no document at all " * 3)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_columns_of_any_name_come_through(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=80)), "en", "ab"[i % 2], 1) for i in range(30)]
    docs = tables(spark, tmp_path, rows, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in CLASH)


def test_labels_that_teach_nothing_drop_no_clean_document(spark, tmp_path):
    rows = [(i, "one kind of text that comes again" if i % 2 else "another kind of text that comes again", "en", "a", 1) for i in range(20)]
    rows += [(100 + i, f"clean words nobody has seen before {i}", "en", "a", 1) for i in range(20)]
    docs = tables(spark, tmp_path, rows, [(i, i % 2) for i in range(20)])
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert kept >= {100 + i for i in range(20)} | {i for i in range(0, 20, 2)}


def test_random_labels_say_nothing_of_unseen_words():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    model = toxicity.fit([(" ".join(rng.choices(words, k=40)), rng.randrange(2)) for _ in range(60)])
    score = toxicity._scorer(model, "score")()
    unseen = [" ".join(f"new{rng.randrange(10**6)}" for _ in range(50)).encode() for _ in range(20)] + [b"", b"one"]
    assert max(score(unseen)["score"]) <= 0.5


def test_a_score_is_the_highest_of_all_windows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(" ".join(rng.choices(words, k=60) + ["vile"] * (y := rng.randrange(2)) + rng.choices(words, k=30)), y) for _ in range(120)]
    model = toxicity.fit(rows)
    score = toxicity._scorer(model, "score")()
    lexicon, net = model[0], toxicity.Network()
    net.p = model[1]
    for text, _ in rows[:10]:
        own = toxicity.words_of(text.encode())
        at, real = toxicity._windows(len(own))
        gates = net.gates(lexicon.parts(own))
        each = [float(net.forward(gates, at[k : k + 1].astype("int32"), real[k : k + 1])[0]) for k in range(len(at))]
        import math

        assert abs(score([text.encode()])["score"][0] - 1 / (1 + math.exp(-max(each)))) < 1e-5
        covered = {int(x) for row, ok in zip(at, real, strict=True) for x in row[ok]}
        assert covered == set(range(len(own)))
