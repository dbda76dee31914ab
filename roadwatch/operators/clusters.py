"""Density clusters of incident locations and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators.neighbours import KEYS, PAIR_LIMIT, Grid, cell, linked_cells, node, radius_totals
from roadwatch.operators.ranking import global_row_number
from roadwatch.session import cut_lineage


# ------------------------------------------------------- connected components
def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of its component.

    Alternating large and small stars; rounds grow with the logarithm of the
    graph. Each round is checkpointed, and the loop stops when nothing changed.
    """
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    stars, before = cut_lineage(stars), None
    while True:
        seen = Observation()   # size and digest are taken while the round is written
        stars = cut_lineage(_small_star(_large_star(stars)).observe(
            seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("digest")))
        now = seen.get
        if now == before:
            break
        before = now
    return nodes.join(stars, nodes.node == stars.a, "left").select("node", F.coalesce("b", "node").alias("root"))


# --------------------------------------------------------------------- dbscan
def dbscan(df: DataFrame, eps: float = S.EPS_METRES, min_samples: int = S.MIN_SAMPLES, world: str | None = None,
           limit: int = PAIR_LIMIT) -> DataFrame:
    """Add ``cluster_id`` (-1 is noise) to rows with id, lat and lon.

    Rows with the same coordinates are one weighted point. In a cell of diagonal eps all
    points are neighbours, so a cell with ``min_samples`` rows is core without any
    comparison, and clusters are components of *cells*. Ids follow the smallest
    core row id; a border row takes the lowest cluster in reach. ``world`` (a small
    integer column) clusters several slices of the table in the same pass.
    """
    rows = df.withColumn("world", F.col(world) if world else F.lit(0))
    merged = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    points = cut_lineage(merged)
    grid = Grid.fit(eps, points)
    celled = grid.index(points).select(*KEYS, "n", "first_id", *cell(0, "c"))
    weights = celled.groupBy("cy", "cx").agg(F.sum("n").alias("w"))
    celled = celled.join(weights, ["cy", "cx"])

    degrees = radius_totals(celled.filter(F.col("w") < min_samples), points, eps, {"n": "sum"}, limit=limit, grid=grid)
    degrees = degrees.withColumnRenamed("n", "degree")
    celled = celled.join(degrees, KEYS, "left").withColumn(
        "core", (F.col("w") >= min_samples) | (F.coalesce("degree", F.lit(0)) >= min_samples))
    celled = cut_lineage(celled.select(*KEYS, "first_id", "core", node("cy", "cx").alias("node")))

    core = celled.filter("core")
    cells = core.groupBy("world", "node").agg(F.min("first_id").alias("first_id"))
    roots = components(cells.select("node"), linked_cells(core, grid, limit))
    rooted = cells.join(roots, "node")
    starts = rooted.groupBy("world", "root").agg(F.min("first_id").alias("first_id"))
    numbered = global_row_number(starts, _id_bucket(starts, "first_id"), ["first_id"], ["world"], "rank")
    ids = cut_lineage(rooted.join(numbered.select("root", (F.col("rank") - 1).cast("int").alias("cluster_id")), "root")
                      .select("node", "cluster_id"))

    core = core.join(ids, "node").select(*KEYS, "cluster_id")
    border = radius_totals(celled.filter("NOT core"), core, eps, {"cluster_id": "min"}, limit=limit, grid=grid)
    labels = core.unionByName(border)
    return rows.join(labels, KEYS, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).drop("world")


def _id_bucket(df: DataFrame, key: str):
    """A bucket that grows with the id: its place among sampled ids, so dense stretches far from zero are spread too."""
    kind = df.schema[key].dataType
    sample = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(256).collect()
    limits = sorted({r[0] for r in sample}, key=str.encode if kind.typeName() == "string" else None)
    return F.size(F.filter(F.array(*map(F.lit, limits)).cast(f"array<{kind.simpleString()}>"), lambda x: x <= F.col(key))).cast("long")


def with_time_slice(df: DataFrame) -> DataFrame:
    return df.withColumn("time_slice", F.when(F.col("time_band").isin(*S.PEAK_BANDS), "peak").otherwise("offpeak"))


def temporal_dbscan(sp: DataFrame, eps: float = S.EPS_METRES, min_samples: int = S.MIN_SAMPLES) -> DataFrame:
    """Peak and off-peak clusters from one run over both slices."""
    sliced = with_time_slice(sp).withColumn("_slice", (F.col("time_slice") == "peak").cast("int"))
    return dbscan(sliced, eps, min_samples, world="_slice").drop("_slice")


# ----------------------------------------------------------------- statistics
def noise_filter(clustered: DataFrame) -> DataFrame:
    return clustered.filter(F.col("cluster_id") >= 0)


def top_label(counts: DataFrame, groups: list[str], label: str, name: str) -> DataFrame:
    """Most common label; a placeholder gives way to the second, or to 'unnamed area'."""
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), label)
    ranked = counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 2)
    first, second = F.max(F.when(F.col("_r") == 1, F.col(label))), F.max(F.when(F.col("_r") == 2, F.col(label)))
    named = F.when(~first.isin(*S.PLACEHOLDER_LABELS), first).otherwise(F.coalesce(second, F.lit("unnamed area")))
    return ranked.groupBy(*groups).agg(named.alias(name))


def label_counts(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    return df.groupBy(*groups, label).agg(F.count("*").alias("n"))


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Size, centroid, rates, impact, labels and risk level per cluster."""
    df = noise_filter(clustered)
    stats = df.groupBy("cluster_id").agg(
        F.count("*").alias("size"), C.stable_round(F.avg("lat"), 4).alias("centroid_lat"),
        C.stable_round(F.avg("lon"), 4).alias("centroid_lon"),
        F.round(F.avg("closure"), 4).alias("closure_rate"), F.round(F.avg("impact_score"), 4).alias("mean_impact"),
        F.sum("impact_score").alias("total_impact"), F.round(F.avg("is_high_priority"), 4).alias("high_priority_rate"))
    key = ["cluster_id"]
    for label, name in (("junction", "top_junction"), ("corridor", "top_corridor")):
        stats = stats.join(top_label(label_counts(df, key, label), key, label, name), key)
    causes = label_counts(df, key, "cause").groupBy(*key).agg(
        F.min_by("cause", F.struct(-F.col("n"), F.col("cause"))).alias("dominant_cause"))
    return stats.join(causes, key).withColumn("risk_level", C.cluster_risk(F.col("closure_rate"), F.col("mean_impact")))


def cluster_counts(clustered: DataFrame) -> DataFrame:
    noise = F.col("cluster_id") == -1
    return clustered.agg(
        F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("n_clusters"), F.count_if(noise).alias("n_noise"),
        F.round(F.avg(noise.cast("int")), 4).alias("noise_fraction"), F.count("*").alias("n_rows"))


def temporal_cluster_stats(clustered: DataFrame) -> DataFrame:
    """Per slice and cluster; the risk level uses unrounded values and an inclusive 6 %."""
    df = noise_filter(clustered)
    key = ["time_slice", "cluster_id"]
    rate, impact = F.avg("closure"), F.avg("impact_score")
    stats = df.groupBy(*key).agg(
        F.count("*").alias("size"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.round(rate, 4).alias("closure_rate"), F.round(impact, 2).alias("mean_impact"),
        C.cluster_risk(rate, impact, closed_lower=True).alias("risk_level"))
    causes = label_counts(df, key, "cause").groupBy(*key).agg(
        F.min_by("cause", F.struct(-F.col("n"), F.col("cause"))).alias("top_cause"))
    return stats.join(causes, key)


def risk_level_map(stats: DataFrame):
    """One row: map of risk level to number of clusters."""
    counts = stats.groupBy("risk_level").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_level", "n")))).alias("risk_level_counts"))


def assign_cluster(points: DataFrame, nearest: DataFrame, stats: DataFrame, eps: float = S.EPS_METRES, box: float = 0.05) -> DataFrame:
    """Cluster of each point (point_id, lat, lon) from the centroids within ±box degrees.

    Both sides meet on a box-sized grid. A centroid needs min_samples rows in its
    own neighbourhood, so a grid cell holds a bounded number of them.
    """
    points = points.withColumn("world", F.lit(0)).join(nearest, KEYS).drop("world")
    c = stats.select("cluster_id", "risk_level", "mean_impact", "closure_rate", "centroid_lat", "centroid_lon",
                     F.floor(F.col("centroid_lat") / box).alias("gy"), F.floor(F.col("centroid_lon") / box).alias("gx"))
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
    probe = points.filter(F.col("distance_m") <= 2 * eps).withColumn("o", around).withColumns({
        "gy": F.floor(F.col("lat") / box) + F.col("o.y"), "gx": F.floor(F.col("lon") / box) + F.col("o.x")})
    dy, dx = F.abs(F.col("centroid_lat") - F.col("lat")), F.abs(F.col("centroid_lon") - F.col("lon"))
    hits = probe.join(c, ["gy", "gx"]).filter((dy < box) & (dx < box))
    best = hits.groupBy("point_id").agg(F.min_by(
        F.struct("cluster_id", "risk_level", "mean_impact", "closure_rate"), F.struct(dy + dx, F.col("cluster_id"))).alias("b"))
    far = F.col("distance_m") > 2 * eps
    return points.join(best, "point_id", "left").select(
        "point_id", F.coalesce("b.cluster_id", F.lit(-1)).alias("cluster_id"),
        F.when(far, "UNKNOWN").otherwise(F.coalesce("b.risk_level", F.lit("LOW"))).alias("risk_level"),
        F.col("b.mean_impact").alias("mean_impact"), F.col("b.closure_rate").alias("closure_rate"),
        F.round("distance_m", 1).alias("distance_to_nearest_m"))
