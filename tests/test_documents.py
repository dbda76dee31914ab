"""Documents written in parallel, request batches and forest scores inside a query."""

import glob
import json
import math

import pytest
from pyspark.sql import Observation, functions as F

import __spark_entry__ as E
from roadwatch.operators import anomaly as A, clusters as K
from roadwatch.sources import collections as J, hotspots as H


def documents(path):
    return json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))))


def test_ordered_parts_join_to_one_document(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
        ends = spark.createDataFrame([('{"entries":[', '],"figures":{"n":5}}')], "head string, tail string")
        assert J.write_document(rows, F.to_json(F.struct("k")), ["k"], f"{tmp_path}/a", ends) == 5000
        assert len(glob.glob(f"{tmp_path}/a/part-*")) > 1
        assert documents(f"{tmp_path}/a") == {"entries": [{"k": i} for i in range(5000)], "figures": {"n": 5}}
        assert J.read_entries(spark, f"{tmp_path}/a", "k long").agg(F.sum("entry.k"), F.count("*")).first() == (5000 * 4999 // 2, 5000)
        assert J.read_tails(spark, f"{tmp_path}/a", "n int", "figures").first().figures.n == 5
        assert J.write_document(rows.limit(0), F.to_json(F.struct("k")), ["k"], f"{tmp_path}/b", ends) == 0
        assert documents(f"{tmp_path}/b")["entries"] == [] and J.read_entries(spark, f"{tmp_path}/b", "k long").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_collection_per_slice(spark, tmp_path):
    stats = spark.createDataFrame([("peak", 0, 12.9, 77.5, 5, "HIGH"), ("peak", 1, 12.8, 77.4, 9, "LOW"), ("offpeak", 0, 13.0, 77.6, 7, "LOW")],
                                  "time_slice string, cluster_id int, centroid_lat double, centroid_lon double, size long, risk_level string")
    counts = spark.createDataFrame([("peak", 2, 3), ("offpeak", 1, 0), ("empty", 0, 4)], "time_slice string, n_clusters long, n_noise long")
    assert H.write_collections(stats, counts, f"{tmp_path}/s", by="time_slice") == 3
    peak, empty = (documents(f"{tmp_path}/s/time_slice={s}") for s in ("peak", "empty"))
    assert [f["properties"]["cluster_id"] for f in peak["features"]] == [0, 1] and peak["type"] == "FeatureCollection"
    assert peak["features"][1]["geometry"] == {"type": "Point", "coordinates": [77.4, 12.8]}
    assert peak["metadata"]["risk_level_counts"] == {"HIGH": 1, "LOW": 1} and peak["metadata"]["n_noise"] == 3
    assert empty["features"] == [] and empty["metadata"]["n_noise"] == 4


REQUESTS = [("Road 1", "3", "4"), (None, "3", "4"), (" ", "3", "4"), ("Road 1", "24", "4"), ("Road 1", "-1", "4"), ("Road 1", "x", "4"), ("Road 1", "3.5", "4"),
            ("Road 1", None, "4"), ("Road 1", "3", "-1"), ("Road 1", "3", None), ("Road 1", "3", "2.5"), ("Road 2", "0", "0"), ("Road 2", "23.0", "1e3")]


def test_requests_are_split_and_counted(spark):
    seen = Observation("requests")
    valid, refused = A.split_requests(spark.createDataFrame(REQUESTS, "corridor string, hour string, event_count string"), seen)
    assert sorted((r.corridor, r.hour, r.event_count) for r in valid.collect()) == [("Road 1", 3, 4), ("Road 2", 0, 0), ("Road 2", 23, 1000)]
    assert seen.get == {"requests": 13, "refused": 10}
    reasons = sorted(r.problem.split()[0] for r in refused.collect())
    assert reasons == ["corridor"] * 2 + ["event_count"] * 3 + ["hour"] * 5
    numbers = spark.createDataFrame([("a", 5, 7), ("a", 25, 7)], "corridor string, hour int, event_count long")
    assert [tuple(r) for r in A.split_requests(numbers)[0].collect()] == [("a", 5, 7)]


def test_forest_in_a_query_equals_the_batch(spark):
    base = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 20).alias("corridor"), (F.col("id") % 24).alias("hour"), (F.col("id") * F.col("id") % 97).alias("event_count"))
    leaves = A.fit_forest(base, trees=20).persist()
    offset = base.agg(F.lit(1)).select(A.forest_offset(base, leaves)).first()[0]
    counts = spark.range(-1, 300).select(F.when(F.col("id") >= 0, F.col("id")).alias("event_count"))
    batch = {r.event_count: (r.is_anomaly, r.confidence) for r in A.forest_detect(counts, leaves, F.lit(offset)).collect()}
    inside = {r.event_count: (r.is_anomaly, r.confidence) for r in A.ForestTable(leaves, offset).flag(counts).collect()}
    assert inside == batch and any(f for f, _ in batch.values()) and not all(f for f, _ in batch.values())
    assert all(0 <= c <= 1 for _, c in batch.values())


def test_stream_scores_equal_the_batch(spark, sf):
    streamed = {(r.corridor, str(r.hour_start)): (r.event_count, r.is_anomaly, r.confidence) for r in E.queries()["stream_forest_flags"](spark, sf).collect()}
    batch = {(r.corridor, f"{r.day} {r.hour:02d}:00:00"): (r.event_count, r.is_anomaly, r.confidence) for r in E.queries()["isolation_forest_score"](spark, sf).collect()}
    assert streamed == batch and len(batch) > 50
    forest = E.queries()["score_request_forest"](spark, sf).collect()
    assert forest and all(r.is_anomaly is not None and 0 <= r.confidence <= 1 for r in forest)


def test_numeric_ids_fill_buckets(spark):
    df = spark.range(10 ** 9, 10 ** 9 + 200_000).toDF("k")
    sizes = [r["count"] for r in df.groupBy(K._id_bucket(df, "k").alias("b")).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 200_000 / 20
    pairs = df.select("k", K._id_bucket(df, "k").alias("b")).agg(F.max(F.struct("k", "b")).alias("hi"), F.min(F.struct("k", "b")).alias("lo"), F.max("b").alias("b")).first()
    assert pairs.hi.b == pairs.b and pairs.lo.b == 0
