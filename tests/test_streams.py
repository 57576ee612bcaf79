"""Streams over shuffled micro-batches give the rows of the batch operators, and their state goes when it has ended."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import state
from tessella.streaming import ordered

START = datetime(2024, 1, 1)


def streamed(spark, folder, rows, schema, ts, make, parts, last):
    """What a stream gives for rows dealt to files out of order, and what its state stores still hold; last ends the stream."""
    for k, part in enumerate([*parts(rows), [last(1)], [last(2)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = f"s{random.randrange(1 << 40)}"
    asked = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    asked.awaitTermination()
    left = asked.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.table(name), left


def shuffled(rng, size, reach):
    """Files in rough order of time: rows change places with others up to `reach` places away."""

    def parts(rows):
        mixed = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, reach))
        return [[rows[i] for i in mixed[a : a + size]] for a in range(0, len(rows), size)]

    return parts


@pytest.fixture
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cache(spark, tmp_path, few):
    rng = random.Random(1)
    rows, at = [], START
    for i in range(240):
        at += timedelta(seconds=rng.choice([0, 1, 5, 40]))
        rows.append((i, rng.choice("xy"), f"n{rng.randrange(12)}", at))
    schema = "id long, cache string, name string, ts timestamp"
    make = lambda s: ordered.cache_stream(s, "cache", "name", "ts", "id", late="5 minutes", ttl=120, most=5)
    got, left = streamed(spark, tmp_path, rows, schema, "ts", make, shuffled(rng, 40, 12), lambda k: (1000 + k, "end", "n", START + timedelta(days=k)))
    batch = spark.createDataFrame(rows, schema).withColumn("second", F.floor(F.unix_millis("ts") / 1000).cast("long"))
    want = state.bounded_cache(batch, "cache", "name", "second", ["ts", "id"], ttl=120, most=5)
    assert {(r.tie, r.hit) for r in got.where("cache <> 'end'").collect()} == {(r.id, r.hit) for r in want.collect()}
    assert 0 < sum(r.hit for r in want.collect()) < 200
    assert left <= 4  # the last rows that end the stream; the caches themselves have expired


def test_idle(spark, tmp_path, few):
    rng = random.Random(2)
    rows = []
    for load in range(12):
        began = START + timedelta(seconds=20 * load)
        for _ in range(rng.randint(1, 8)):
            start = began + timedelta(milliseconds=rng.randint(0, 3000))
            rows.append((f"l{load}", start, start + timedelta(milliseconds=rng.choice([0, 50, 400, 1500, 9000]))))
    marks = sorted([(k, a, 1) for k, a, _ in rows] + [(k, b, -1) for k, _, b in rows], key=lambda m: m[1])
    schema = "load string, ts timestamp, step int"
    make = lambda s: ordered.idle_stream(s, "load", "ts", "step", late="30 seconds")
    got, left = streamed(spark, tmp_path, marks, schema, "ts", make, shuffled(rng, 30, 10), lambda k: ("end", START + timedelta(days=k), 1))
    requests = spark.createDataFrame(rows, "load string, a timestamp, b timestamp").select("load", F.unix_millis("a").alias("a"), F.unix_millis("b").alias("b"))
    want = {(r.load, r.idle_at) for r in state.idle_reached(requests, "load", "a", "b").collect()}
    assert {(r.load, r.idle_at) for r in got.where("load <> 'end'").collect()} == want and len(want) == 12
    assert left <= 4


def test_backoff(spark, tmp_path, few):
    rng = random.Random(3)
    rows, at = [], START
    for i in range(200):
        at += timedelta(seconds=rng.choice([1, 100, 400, 2000]))
        rows.append((i, rng.choice("ab"), at, rng.random() < 0.6))
    schema = "id long, engine string, ts timestamp, bad boolean"
    make = lambda s: ordered.backoff_stream(s, "engine", "ts", "id", "bad", late="2 hours", base=300)
    got, left = streamed(spark, tmp_path, rows, schema, "ts", make, shuffled(rng, 35, 4), lambda k: (1000 + k, "end", START + timedelta(days=10 * k), False))
    batch = spark.createDataFrame(rows, schema).withColumn("second", F.floor(F.unix_millis("ts") / 1000).cast("long"))
    want = state.suspensions(batch, "engine", "second", "bad", ["ts", "id"], base=300)
    assert {(r.tie, r.outcome, r.captcha_count, r.resume_at) for r in got.where("engine <> 'end'").collect()} == {(r.id, r.outcome, r.captcha_count, r.resume_at) for r in want.collect()}
    assert left <= 4


def test_rows_too_late_are_dropped(spark, tmp_path, few):
    rows = [(1, "a", START), (2, "a", START + timedelta(hours=5)), (3, "a", START + timedelta(hours=9)), (4, "a", START + timedelta(minutes=1))]
    schema = "id long, engine string, ts timestamp"
    make = lambda s: ordered.backoff_stream(s.withColumn("bad", F.lit(True)), "engine", "ts", "id", "bad", late="1 minute")
    got, _ = streamed(spark, tmp_path, rows, schema, "ts", make, lambda r: [[x] for x in r], lambda k: (10 + k, "end", START + timedelta(days=k)))
    assert sorted(r.tie for r in got.where("engine = 'a'").collect()) == [1, 2, 3]
