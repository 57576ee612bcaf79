"""The captures and cookies formats: splits, chosen columns, round trips, and tasks that fail."""

import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import cookies
from tessella.sources import formats


@pytest.fixture
def captures(spark, tmp_path):
    formats.register(spark)
    rng = random.Random(1)
    rows = [{"url": f"https://é{k}.example/", "status": 200 + k % 3, "headers": {"content-type": "text/html", "x": str(k)} if k % 4 else None, "body": base64.b64encode(rng.randbytes(k % 50)).decode() if k % 5 else None, "redirected_from": [f"http://r{k}/"] * (k % 3)} for k in range(500)]
    os.makedirs(f"{tmp_path}/in")
    for name, part in (("a.jsonl", rows[:200]), ("b.jsonl", rows[200:]), ("empty.jsonl", [])):
        with open(f"{tmp_path}/in/{name}", "w") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" + "\n" * (len(r["redirected_from"]) == 2) for r in part)
    return f"{tmp_path}/in", rows


@pytest.mark.parametrize("split", [997, 5000, 1 << 20])
def test_every_line_is_read_once(spark, captures, split):
    path, rows = captures
    read = spark.read.format("captures").option("split", split).load(path)
    assert read.rdd.getNumPartitions() == sum(-(-os.path.getsize(f"{path}/{n}") // split) for n in os.listdir(path))
    got = {r.url: r for r in read.collect()}
    assert len(got) == read.count() == len(rows)
    for r in rows:
        g = got[r["url"]]
        assert (g.status, g.headers, g.redirected_from) == (r["status"], r["headers"], r["redirected_from"])
        assert (None if g.body is None else bytes(g.body)) == (None if r["body"] is None else base64.b64decode(r["body"]))


def test_chosen_columns(spark, captures):
    path, rows = captures
    read = spark.read.format("captures").schema("status int, url string").load(f"{path}/*.jsonl")
    assert read.columns == ["status", "url"]
    assert read.groupBy("status").count().orderBy("status").collect()[0]["count"] == sum(r["status"] == 200 for r in rows)
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("captures").load(f"{path}/none-*").count()


def jar_of(spark, rows):
    return spark.createDataFrame(rows, formats.COOKIE).repartition(3)


def test_cookies_round_trip(spark, tmp_path):
    formats.register(spark)
    folder = f"{tmp_path}/jar"
    rows = [(f"n{k}", f"v{k}", "d.example", "/", k % 2 == 0, False, "Lax", None if k % 3 else 100 * k) for k in range(40)]
    jar_of(spark, rows).write.format("cookies").mode("append").option("now", 1500).save(folder)
    alive = {r for r in rows if r[7] is None or r[7] > 1500}
    read = spark.read.format("cookies").load(folder)
    assert {tuple(r) for r in read.collect()} == alive and formats.manifest(folder)["count"] == len(alive)
    jar_of(spark, [("n1", "new", "d.example", "/", True, True, None, 0)]).write.format("cookies").mode("append").save(folder)
    assert formats.manifest(folder)["count"] == len(alive) + 1
    later = spark.read.format("cookies").load(folder).withColumn("seq", F.when(F.col("value") == "new", 1).otherwise(0).cast("long"))
    held = {r.name: (r.value, r.host_only, r.same_site, r.expires) for r in cookies.bulk_load(read.withColumn("host_only", F.lit(False)).where("false"), later, "seq").collect()}
    assert held["n1"] == ("new", False, "Lax", None) and len(held) == len(alive)
    jar_of(spark, rows[:2]).write.format("cookies").mode("overwrite").save(folder)
    assert {tuple(r) for r in spark.read.format("cookies").load(folder).collect()} == set(rows[:2])
    assert len([n for n in os.listdir(folder) if n.startswith("part-")]) == len(formats.manifest(folder)["parts"])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    folder = f"{tmp_path}/jar"
    jar_of(spark, [("a", "1", "d", "/", False, False, "Lax", None)]).write.format("cookies").mode("append").save(folder)
    before = sorted(os.listdir(folder))

    @F.udf("string")
    def breaks(v):
        if v == "v17":
            raise ValueError("no such cookie")
        return v

    bad = jar_of(spark, [(f"n{k}", f"v{k}", "d", "/", False, False, "Lax", None) for k in range(30)]).withColumn("value", breaks("value"))
    with pytest.raises(Exception, match="no such cookie"):
        bad.write.format("cookies").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == before
    assert [r.name for r in spark.read.format("cookies").load(folder).collect()] == ["a"]


def test_an_empty_jar(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("cookies").load(f"{tmp_path}/none").count() == 0
    jar_of(spark, []).write.format("cookies").mode("append").save(f"{tmp_path}/jar")
    assert spark.read.format("cookies").load(f"{tmp_path}/jar").count() == 0
