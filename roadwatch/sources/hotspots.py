"""GeoJSON hotspot files and other spatial artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadwatch import settings as S
from roadwatch.sources.collections import write_document


def point_features(stats: DataFrame, lat: str = "centroid_lat", lon: str = "centroid_lon", **extra) -> DataFrame:
    """One GeoJSON Feature per cluster; ``event_count`` repeats ``size`` for map clients."""
    props = [F.col(c) for c in stats.columns if c not in ("lat", "lon")]
    props += [F.col("size").alias("event_count")] + [F.lit(v).alias(k) for k, v in extra.items()]
    return stats.select(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")).alias("feature"))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """One Feature per line, in parallel: the layout for any number of clusters."""
    features.select(F.to_json("feature").alias("value")).write.text(path)


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


METADATA = "generated_at string, n_clusters bigint, n_noise bigint, eps_metres double, min_samples int, risk_level_counts map<string,bigint>"
FEATURE = ("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<cluster_id:int,size:bigint,event_count:bigint,risk_level:string,"
           "time_slice:string,closure_rate:double,mean_impact:double>")


def _ends(stats: DataFrame, counts: DataFrame, by: str | None) -> DataFrame:
    """Head and tail of each collection; the tail carries counts by risk level, a handful of values."""
    keys = [by] if by else []
    levels = stats.groupBy(*keys, "risk_level").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_level", "n")))).alias("levels"))
    head = counts.join(levels, keys, "left") if keys else counts.crossJoin(levels)
    empty = F.create_map().cast("map<string,bigint>")
    metadata = F.struct(
        F.current_timestamp().cast("string").alias("generated_at"), "n_clusters", "n_noise", F.lit(S.EPS_METRES).alias("eps_metres"),
        F.lit(S.MIN_SAMPLES).alias("min_samples"), F.coalesce("levels", empty).alias("risk_level_counts"))
    return head.select(*keys, F.lit('{"type":"FeatureCollection","features":[').alias("head"),
                       F.concat(F.lit('],"metadata":'), F.to_json(metadata), F.lit("}")).alias("tail"))


def write_collections(stats: DataFrame, counts: DataFrame, path: str, by: str | None = None, **extra) -> int:
    """Clusters as one FeatureCollection, or one per value of ``by``; ``counts`` has n_clusters and n_noise for each."""
    features = point_features(stats, **extra)
    keys = [F.col(f"feature.properties.{c}").alias(c) for c in ([by] if by else []) + ["cluster_id"]]
    return write_document(features.select(*keys, "feature"), F.to_json("feature"), ["cluster_id"], path, _ends(stats, counts, by), by)


def write_density(grid: DataFrame, path: str) -> None:
    grid.write.partitionBy("filter_kind").parquet(path)


def risk_level_filter(stats: DataFrame, level: str) -> DataFrame:
    return stats.filter(F.col("risk_level") == F.upper(F.lit(level)))
