"""Tables with versions, and edges of hubs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvid.operators import etl
from corvid.operators import graph as G
from corvid.sources.versions import Conflict, Versioned


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    t = Versioned.create(base, f"file://{tmp_path}/t", ["k"], 32)
    before = t.manifest()
    assert rows(t.read()) == rows(base)
    changes = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (5000, "new", 1)], "k long, v string, at int")
    open_reader = t.read()
    told = t.merge(changes, "at")
    after = t.manifest()
    moved = [b for b in after["files"] if before["files"].get(b) != after["files"][b]]
    assert len(moved) == told["buckets"] <= 2 and told["of"] == 32 and told["files"] == sum(len(after["files"][b]) for b in moved)
    assert rows(open_reader) == rows(base) == rows(t.read(0))  # a reader that began before sees what it began with
    assert rows(t.read()) == sorted([(k, "old") for k in range(2000) if k != 5] + [(5, "b"), (5000, "new")])


def test_combine_and_nothing_to_merge(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", '{"x":"1"}'), (2, "b", None)], "k int, c string, j string")
    t = Versioned.create(base, f"file://{tmp_path}/t", ["k"], 4)
    changes = spark.createDataFrame([(1, None, "n", 1), (3, "c", None, 1)], "k int, c string, j string, at int")
    combine = lambda c, old, new: etl.merge_json(old, y=new) if c == "j" else F.coalesce(new, old)
    t.merge(changes, "at", combine)
    assert rows(t.read().select("k", "c")) == [(1, "a"), (2, "b"), (3, "c")]
    assert t.read().where("k = 1").select(F.get_json_object("j", "$.x"), F.get_json_object("j", "$.y")).first() == ("1", "n")
    assert t.merge(changes.limit(0), "at") == {"buckets": 0, "files": 0, "of": 4} and t.read().count() == 3


def test_two_writers(spark, tmp_path, monkeypatch):
    t = Versioned.create(spark.range(10).withColumn("v", F.lit(0)), f"file://{tmp_path}/t", ["id"], 2)
    other = Versioned(spark, f"file://{tmp_path}/t")
    stale = other.manifest()
    t.merge(spark.createDataFrame([(1, 7, 1)], "id long, v int, at int"), "at")
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        other.merge(spark.createDataFrame([(2, 8, 1)], "id long, v int, at int"), "at")
    assert {r["id"]: r["v"] for r in t.read().collect()} == {i: 7 if i == 1 else 0 for i in range(10)}


def test_edges_of_a_hub_are_dealt(spark):
    """A star of a million edges, both ways: no task has more than a small part of what a step finds."""
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("r").alias("rel"))
    step, hubs = G.dealt(G.both_ways(star).select("src", "dst"), hub=20_000)
    assert rows(hubs) == [(0, 50)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(was, ("-1", "false", "25"), strict=True):
            spark.conf.set(k, v)
        front = spark.createDataFrame([(9, 0)], "seed long, id long")
        tasks = G.along(front, step, hubs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 1_000_000 and max(r["count"] for r in tasks) < 200_000
    seeds = spark.createDataFrame([(5,)], "id long")
    assert G.distances(seeds, star, 2).groupBy("distance").count().orderBy("distance").collect() == [(1, 1), (2, 999_999)]
