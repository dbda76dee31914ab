"""Neighbourhood, hotspot and density queries."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from roadwatch import settings as S
from roadwatch.functions.columns import stable_round
from roadwatch.operators import clusters as K, density as D, neighbours as N, ranking
from roadwatch.plans.deployment import hav_sql
from roadwatch.plans.registry import SPATIAL_SQL, artefact, hash_sql, on_spatial, query, spatial
from roadwatch.session import new_folder
from roadwatch.sources import hotspots as H
from roadwatch.sources.collections import read_entries, read_tails

_NEAR = hav_sql("a.lat", "a.lon", "b.lat", "b.lon")
_BAND = "b.lat BETWEEN a.lat - 0.0046 AND a.lat + 0.0046 AND b.lon BETWEEN a.lon - 0.0048 AND a.lon + 0.0048"


# ----------------------------------------------------------------- neighbours
@query("nearby_closure_share", on_spatial(
    f", n AS (SELECT a.id, count(*) AS c FROM sp a JOIN sp b ON {_BAND} WHERE b.closure = 1 AND {_NEAR} <= 500 GROUP BY 1) "
    "SELECT sp.id, round(coalesce(c, 0) / (SELECT greatest(sum(closure), 1) FROM sp)::DOUBLE, 9) AS historical_nearby_closure_rate "
    "FROM sp LEFT JOIN n USING (id)"))
def nearby_closure_share(spark, sf):
    out = N.nearby_closure_share(spatial(spark, sf).select("id", "lat", "lon", "closure"))
    return out.select("id", F.round("historical_nearby_closure_rate", 9).alias("historical_nearby_closure_rate"))


@query("nearby_closure_rate", on_spatial(
    f", n AS (SELECT a.id, avg(b.closure) AS r FROM sp a JOIN sp b ON {_BAND} WHERE {_NEAR} <= 500 GROUP BY 1) "
    "SELECT id, round(r, 9) AS nearby_closure_rate FROM n"))
def nearby_closure_rate(spark, sf):
    out = N.nearby_closure_rate(spatial(spark, sf).select("id", "lat", "lon", "closure"))
    return out.select("id", F.round("nearby_closure_rate", 9).alias("nearby_closure_rate"))


@query("nearby_rate_without_self", on_spatial(
    f", n AS (SELECT a.id, avg(b.closure) AS r FROM sp a JOIN sp b ON {_BAND} WHERE a.id <> b.id AND {_NEAR} <= 500 GROUP BY 1) "
    "SELECT sp.id, round(r, 9) AS nearby_closure_rate FROM sp LEFT JOIN n USING (id)"))
def nearby_rate_without_self(spark, sf):
    out = N.nearby_closure_rate(spatial(spark, sf).select("id", "lat", "lon", "closure"), exclude_self=True)
    return out.select("id", F.round("nearby_closure_rate", 9).alias("nearby_closure_rate"))


@query("nearby_fold_rate", on_spatial(
    f", fo AS (SELECT *, CAST({hash_sql('id', 42)} % 5 AS INTEGER) AS fold FROM sp), n AS (SELECT a.id, count(*) AS n, sum(b.closure) AS s FROM fo a JOIN fo b ON {_BAND} "
    f"WHERE a.fold <> b.fold AND {_NEAR} <= 500 GROUP BY 1) SELECT fo.id, fo.fold, CAST(coalesce(n, 0) AS BIGINT) AS neighbours, CAST(coalesce(s, 0) AS BIGINT) AS closures FROM fo LEFT JOIN n USING (id)"))
def nearby_fold_rate(spark, sf):
    """Neighbours and closures within the radius, those of the row's own fold left out: the model feature's counts."""
    rows = ranking.kfolds(spatial(spark, sf).select("id", "lat", "lon", "closure"))
    out = N.nearby_fold_counts(rows, "closure", S.N_FOLDS, "n", "s")
    others = {c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) - F.get(c, F.col("fold")) for c in ("n", "s")}
    return out.select("id", "fold", others["n"].alias("neighbours"), others["s"].alias("closures"))


@query("eps_pairs", on_spatial(
    f" SELECT a.id, count(*) AS neighbours FROM sp a JOIN sp b ON {_BAND} WHERE {_NEAR} <= 500 GROUP BY 1"))
def eps_pairs(spark, sf):
    return N.neighbour_counts(spatial(spark, sf).select("id", "lat", "lon")).select("id", "neighbours")


POINTS_SQL = (", pt AS (SELECT vec_id AS point_id, least(greatest(13.035::DOUBLE + embedding[1]::DOUBLE * 0.8, 12.7), 13.4) AS lat, "
              "least(greatest(77.54::DOUBLE + embedding[2]::DOUBLE * 0.8, 77.2), 77.9) AS lon FROM embeddings)")


def query_points(spark, sf):
    """Second point set: two embedding dimensions scaled into (and a little beyond) the box."""
    e = spark.read.parquet(os.path.join(sf, "embeddings.parquet"))
    return e.selectExpr(
        "vec_id AS point_id", "least(greatest(13.035D + cast(embedding[0] AS double) * 0.8D, 12.7D), 13.4D) AS lat",
        "least(greatest(77.54D + cast(embedding[1] AS double) * 0.8D, 77.2D), 77.9D) AS lon")


NEAREST_SQL = SPATIAL_SQL + POINTS_SQL + f", nd AS (SELECT a.point_id, min({_NEAR}) AS d FROM pt a, sp b GROUP BY 1)"


@query("nearest_incident_distance", NEAREST_SQL + " SELECT point_id, round(d, 1) AS distance_to_nearest_m FROM nd")
def nearest_incident_distance(spark, sf):
    pts = query_points(spark, sf)
    near = N.nearest_distance(pts, spatial(spark, sf))
    return pts.withColumn("world", F.lit(0)).join(near, N.KEYS).select("point_id", F.round("distance_m", 1).alias("distance_to_nearest_m"))


_NODES = (", nd AS (SELECT DISTINCT CAST(round(lat * 500) AS BIGINT) AS y, CAST(round(lon * 500) AS BIGINT) AS x FROM sp), "
          "nodes AS (SELECT y * 100000 + x AS node, y / 500.0::DOUBLE AS lat, x / 500.0::DOUBLE AS lon, y, x FROM nd), "
          "edges AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)), "
          "mid AS (SELECT DISTINCT (lat + end_lat) / 2 AS lat, (lon + end_lon) / 2 AS lon FROM sp WHERE has_end_coord), "
          f"bl AS (SELECT DISTINCT a.node FROM nodes a JOIN mid b ON {_BAND} WHERE {_NEAR} < 200)")


def _network(spark, sf):
    """Street grid derived from incident places: a node per 0.002 degrees, edges to the next ones."""
    cell = spatial(spark, sf).selectExpr("cast(round(lat * 500) AS bigint) AS y", "cast(round(lon * 500) AS bigint) AS x").distinct()
    nodes = cell.selectExpr("y * 100000 + x AS node", "y / 500D AS lat", "x / 500D AS lon", "y", "x")
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in ((0, 1), (1, 0))]))
    ahead = nodes.select(F.col("node").alias("u"), "y", "x", step.alias("s")).select(
        "u", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    edges = ahead.join(nodes.select("y", "x", F.col("node").alias("v")), ["y", "x"]).select("u", "v")
    return nodes.select("node", "lat", "lon"), edges


@query("block_nearby", SPATIAL_SQL + _NODES + " SELECT 'blocked' AS kind, node AS u, node AS v FROM bl UNION ALL SELECT 'open', u, v FROM edges "
       "WHERE u NOT IN (SELECT node FROM bl) AND v NOT IN (SELECT node FROM bl)")
def block_nearby(spark, sf):
    nodes, edges = _network(spark, sf)
    blocked = N.blocked_nodes(nodes, spatial(spark, sf)).select("node").persist()
    left = N.open_edges(edges, blocked)
    return blocked.select(F.lit("blocked").alias("kind"), F.col("node").alias("u"), F.col("node").alias("v")).unionByName(
        left.select(F.lit("open").alias("kind"), "u", "v"))


# ------------------------------------------------------------------- clusters
def dbscan_sql(source: str = "sp") -> str:
    """Point-level definition: neighbour pairs, core rows, smallest reachable core id, border rule."""
    return f""", px AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM {source} a JOIN {source} b ON {_BAND} WHERE {_NEAR} <= 500),
core AS MATERIALIZED (SELECT i AS id FROM px GROUP BY 1 HAVING count(*) >= 5),
ce AS MATERIALIZED (SELECT i, j FROM px WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
lab(id, l) USING KEY (id) AS (SELECT id, id FROM core UNION SELECT ce.j, min(t.l) FROM lab t JOIN ce ON ce.i = t.id
 JOIN recurring.lab r ON r.id = ce.j WHERE t.l < r.l GROUP BY ce.j),
cid AS (SELECT l, dense_rank() OVER (ORDER BY l) - 1 AS c FROM (SELECT DISTINCT l FROM lab)),
lc AS (SELECT id, c FROM lab JOIN cid USING (l)),
bd AS (SELECT px.i AS id, min(lc.c) AS c FROM px JOIN lc ON lc.id = px.j WHERE px.i NOT IN (SELECT id FROM core) GROUP BY 1),
dbl AS (SELECT s.id, CAST(coalesce(lc.c, bd.c, -1) AS INTEGER) AS cluster_id FROM {source} s LEFT JOIN lc USING (id) LEFT JOIN bd USING (id))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


DBSCAN_SQL = _recursive(SPATIAL_SQL + dbscan_sql())
CL_SQL = DBSCAN_SQL + ", cl AS MATERIALIZED (SELECT sp.*, dbl.cluster_id FROM sp JOIN dbl USING (id))"


def _label_sql(col, name):
    return (f"{name} AS (SELECT cluster_id, coalesce(CASE WHEN max(v) FILTER (WHERE r = 1) NOT IN ('no_junction', 'no_zone', 'unknown') "
            f"THEN max(v) FILTER (WHERE r = 1) ELSE max(v) FILTER (WHERE r = 2) END, 'unnamed area') AS {name} FROM (SELECT cluster_id, {col} AS v, "
            f"row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {col}) AS r FROM cl WHERE cluster_id >= 0 GROUP BY 1, 2) GROUP BY 1)")


STATS_SQL = CL_SQL + """, c0 AS (SELECT cluster_id, count(*) AS size, round(avg(lat) + 1e-9::DOUBLE, 4) AS centroid_lat, round(avg(lon) + 1e-9::DOUBLE, 4) AS centroid_lon,
 round(avg(closure), 4) AS closure_rate, round(avg(impact_score), 4) AS mean_impact, CAST(sum(impact_score) AS BIGINT) AS total_impact,
 round(avg(is_high_priority), 4) AS high_priority_rate FROM cl WHERE cluster_id >= 0 GROUP BY 1),
""" + _label_sql("junction", "top_junction") + ", " + _label_sql("corridor", "top_corridor") + """,
dom AS (SELECT cluster_id, cause AS dominant_cause FROM (SELECT cluster_id, cause, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, cause) AS r
 FROM cl WHERE cluster_id >= 0 GROUP BY 1, 2) WHERE r = 1),
st AS MATERIALIZED (SELECT *, CASE WHEN closure_rate > 0.10 OR mean_impact >= 7 THEN 'HIGH' WHEN closure_rate > 0.06 OR mean_impact >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
 FROM c0 JOIN top_junction USING (cluster_id) JOIN top_corridor USING (cluster_id) JOIN dom USING (cluster_id))"""


def clustered(spark, sf):
    return artefact(spark, sf, "clustered", lambda: K.dbscan(spatial(spark, sf)))


def cluster_table(spark, sf):
    return artefact(spark, sf, "cluster-stats", lambda: K.cluster_stats(clustered(spark, sf)))


def sliced(spark, sf):
    return artefact(spark, sf, "sliced-clusters", lambda: K.temporal_dbscan(spatial(spark, sf)))


@query("dbscan", DBSCAN_SQL + " SELECT id, cluster_id FROM dbl")
def dbscan(spark, sf):
    return clustered(spark, sf).select("id", "cluster_id")


@query("noise_filter", DBSCAN_SQL + " SELECT id, cluster_id FROM dbl WHERE cluster_id >= 0")
def noise_filter(spark, sf):
    return K.noise_filter(clustered(spark, sf)).select("id", "cluster_id")


@query("cluster_counts", DBSCAN_SQL + " SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id >= 0) AS n_clusters, "
       "count(*) FILTER (WHERE cluster_id < 0) AS n_noise, round(avg(CASE WHEN cluster_id < 0 THEN 1 ELSE 0 END), 4) AS noise_fraction, count(*) AS n_rows FROM dbl")
def cluster_counts(spark, sf):
    return K.cluster_counts(clustered(spark, sf))


@query("cluster_stats", STATS_SQL + " SELECT cluster_id, size, centroid_lat, centroid_lon, closure_rate, mean_impact, total_impact, high_priority_rate FROM st")
def cluster_stats(spark, sf):
    return cluster_table(spark, sf).select(
        "cluster_id", "size", "centroid_lat", "centroid_lon", "closure_rate", "mean_impact", "total_impact", "high_priority_rate")


@query("cluster_top_label", STATS_SQL + " SELECT cluster_id, top_junction, top_corridor, dominant_cause FROM st")
def cluster_top_label(spark, sf):
    return cluster_table(spark, sf).select("cluster_id", "top_junction", "top_corridor", "dominant_cause")


@query("cluster_risk_level", STATS_SQL + " SELECT cluster_id, risk_level FROM st")
def cluster_risk_level(spark, sf):
    return cluster_table(spark, sf).select("cluster_id", "risk_level")


@query("risk_level_filter", STATS_SQL + " SELECT cluster_id, size, risk_level FROM st WHERE risk_level = upper('medium')")
def risk_level_filter(spark, sf):
    return H.risk_level_filter(cluster_table(spark, sf), "medium").select("cluster_id", "size", "risk_level")


@query("risk_level_map", STATS_SQL + " SELECT risk_level, count(*) AS n FROM st GROUP BY 1")
def risk_level_map(spark, sf):
    return K.risk_level_map(cluster_table(spark, sf)).select(F.explode("risk_level_counts").alias("risk_level", "n"))


@query("largest_clusters", STATS_SQL + " SELECT cluster_id, size, risk_level FROM st ORDER BY size DESC, cluster_id LIMIT 15")
def largest_clusters(spark, sf):
    return cluster_table(spark, sf).select("cluster_id", "size", "risk_level").orderBy(F.desc("size"), "cluster_id").limit(15)


@query("top_clusters", STATS_SQL + " SELECT cluster_id, size, top_corridor FROM st WHERE risk_level = 'HIGH' ORDER BY size DESC, cluster_id LIMIT 5")
def top_clusters(spark, sf):
    return (H.risk_level_filter(cluster_table(spark, sf), "high").select("cluster_id", "size", "top_corridor")
            .orderBy(F.desc("size"), "cluster_id").limit(5))


@query("rows_in_clusters", STATS_SQL + " SELECT id, cluster_id FROM cl WHERE cluster_id IN (SELECT cluster_id FROM st WHERE risk_level = 'HIGH')")
def rows_in_clusters(spark, sf):
    high = H.risk_level_filter(cluster_table(spark, sf), "HIGH").select("cluster_id")
    return clustered(spark, sf).join(high, "cluster_id", "left_semi").select("id", "cluster_id")


@query("assign_cluster", STATS_SQL + POINTS_SQL + f""", nd AS (SELECT a.point_id, min({_NEAR}) AS d FROM pt a, sp b GROUP BY 1),
h AS (SELECT pt.point_id, st.*, row_number() OVER (PARTITION BY pt.point_id ORDER BY abs(centroid_lat - lat) + abs(centroid_lon - lon), cluster_id) AS r
 FROM pt JOIN nd USING (point_id) JOIN st ON d <= 1000 AND abs(centroid_lat - lat) < 0.05 AND abs(centroid_lon - lon) < 0.05)
SELECT nd.point_id, coalesce(h.cluster_id, -1) AS cluster_id, CASE WHEN d > 1000 THEN 'UNKNOWN' ELSE coalesce(h.risk_level, 'LOW') END AS risk_level,
 h.mean_impact, h.closure_rate, round(d, 1) AS distance_to_nearest_m FROM nd LEFT JOIN h ON h.point_id = nd.point_id AND h.r = 1""")
def assign_cluster(spark, sf):
    pts = query_points(spark, sf)
    near = N.nearest_distance(pts, spatial(spark, sf))
    return K.assign_cluster(pts, near, cluster_table(spark, sf))


@query("nearest_one", STATS_SQL + """ SELECT id, cluster_id AS nearest FROM (SELECT cl.id, st.cluster_id, row_number() OVER (PARTITION BY cl.id
 ORDER BY abs(centroid_lat - lat) + abs(centroid_lon - lon), st.cluster_id) AS r FROM cl JOIN st ON abs(centroid_lat - lat) < 0.05 AND abs(centroid_lon - lon) < 0.05) WHERE r = 1""")
def nearest_one(spark, sf):
    rows = clustered(spark, sf).select(F.col("id").alias("point_id"), "lat", "lon")
    here = N.prepared(rows, {"distance_m": F.lit(0.0) * F.count("*")})
    out = K.assign_cluster(rows, here, cluster_table(spark, sf)).filter("cluster_id >= 0")
    return out.select(F.col("point_id").alias("id"), F.col("cluster_id").alias("nearest"))


@query("write_hotspots_geojson", STATS_SQL + """ SELECT cluster_id, size AS event_count, centroid_lon AS x, centroid_lat AS y, risk_level, 'Point' AS shape,
 (SELECT count(*) FROM cl WHERE cluster_id < 0) AS n_noise FROM st""")
def write_hotspots_geojson(spark, sf):
    stats, rows = cluster_table(spark, sf), clustered(spark, sf)
    path = new_folder(spark, "hotspots")
    H.write_collections(stats, K.cluster_counts(rows).select("n_clusters", "n_noise"), path, eps_metres=S.EPS_METRES)
    noise = read_tails(spark, path, H.METADATA, "metadata").select("metadata.n_noise").scalar()
    f = read_entries(spark, path, H.FEATURE).select("entry.*")
    return f.select("properties.cluster_id", "properties.event_count", F.col("geometry.coordinates")[0].alias("x"),
                    F.col("geometry.coordinates")[1].alias("y"), "properties.risk_level",
                    F.col("geometry.type").alias("shape"), noise.alias("n_noise"))


_SLICED = SPATIAL_SQL + (", src AS (SELECT *, CASE WHEN time_band IN ('early_morning', 'evening') THEN 'peak' ELSE 'offpeak' END AS time_slice FROM sp), "
                         "pk AS (SELECT * FROM src WHERE time_slice = 'peak'), op AS (SELECT * FROM src WHERE time_slice = 'offpeak')")


def _renamed(sql, tag):
    """The same steps under other names, for a second slice."""
    for name in ("px", "core", "ce", "lab", "cid", "lc", "bd", "dbl"):
        sql = re.sub(rf"\b{name}\b", f"{name}_{tag}", sql)
    return sql


SLICED_SQL = _recursive(_SLICED + _renamed(dbscan_sql("pk"), "p") + _renamed(dbscan_sql("op"), "o")
                        + ", dbs AS MATERIALIZED (SELECT * FROM dbl_p UNION ALL SELECT * FROM dbl_o), cs AS MATERIALIZED (SELECT src.*, cluster_id FROM src JOIN dbs USING (id))")
TSTATS_SQL = SLICED_SQL + """, ts AS (SELECT time_slice, cluster_id, count(*) AS size, round(avg(lat) + 1e-9::DOUBLE, 6) AS lat, round(avg(lon) + 1e-9::DOUBLE, 6) AS lon, round(avg(closure), 4) AS closure_rate,
 round(avg(impact_score), 2) AS mean_impact, CASE WHEN avg(closure) > 0.10 OR avg(impact_score) >= 7 THEN 'HIGH' WHEN avg(closure) >= 0.06 OR avg(impact_score) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
 FROM cs WHERE cluster_id >= 0 GROUP BY 1, 2),
tc AS (SELECT time_slice, cluster_id, cause AS top_cause FROM (SELECT time_slice, cluster_id, cause, row_number() OVER (PARTITION BY time_slice, cluster_id ORDER BY count(*) DESC, cause) AS r
 FROM cs WHERE cluster_id >= 0 GROUP BY 1, 2, 3) WHERE r = 1)"""


@query("temporal_dbscan", SLICED_SQL + " SELECT id, time_slice, cluster_id FROM cs")
def temporal_dbscan(spark, sf):
    return sliced(spark, sf).select("id", "time_slice", "cluster_id")


@query("temporal_cluster_stats", TSTATS_SQL + " SELECT * FROM ts JOIN tc USING (time_slice, cluster_id)")
def temporal_cluster_stats(spark, sf):
    return K.temporal_cluster_stats(sliced(spark, sf)).withColumns(
        {"lat": stable_round(F.col("lat"), 6), "lon": stable_round(F.col("lon"), 6)})


@query("union_slices", TSTATS_SQL + " SELECT time_slice, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS rows_in_clusters FROM ts GROUP BY 1")
def union_slices(spark, sf):
    stats = K.temporal_cluster_stats(sliced(spark, sf))
    both = stats.filter("time_slice = 'peak'").unionByName(stats.filter("time_slice = 'offpeak'"))
    return both.groupBy("time_slice").agg(F.count("*").alias("clusters"), F.sum("size").alias("rows_in_clusters"))


@query("write_hotspot_slices", TSTATS_SQL + """ SELECT ts.time_slice, cluster_id, size AS event_count, risk_level, n_clusters,
 (SELECT count(*) FROM src WHERE src.time_slice = ts.time_slice) - total AS n_noise
 FROM ts JOIN (SELECT time_slice, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS total FROM ts GROUP BY 1) USING (time_slice)""")
def write_hotspot_slices(spark, sf):
    """One FeatureCollection per time slice, written side by side and read back with the figures of its tail."""
    path = new_folder(spark, "hotspot-slices")
    rows = sliced(spark, sf)
    counts = rows.groupBy("time_slice").agg(F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"),
                                            F.count_if(F.col("cluster_id") < 0).alias("n_noise"))
    stats = K.temporal_cluster_stats(rows).withColumnsRenamed({"lat": "centroid_lat", "lon": "centroid_lon"})
    H.write_collections(stats, counts, path, by="time_slice")
    tails = read_tails(spark, path, H.METADATA, "metadata").select("time_slice", "metadata.n_clusters", "metadata.n_noise")
    found = read_entries(spark, path, H.FEATURE).select("time_slice", "entry.properties.cluster_id", "entry.properties.event_count", "entry.properties.risk_level")
    return found.join(F.broadcast(tails), "time_slice")


@query("write_dynamic_hotspots", TSTATS_SQL + " SELECT time_slice, cluster_id, size, risk_level FROM ts")
def write_dynamic_hotspots(spark, sf):
    path = new_folder(spark, "dynamic-hotspots")
    K.temporal_cluster_stats(sliced(spark, sf)).write.option("header", True).csv(path)
    back = spark.read.schema("time_slice string, cluster_id int, size bigint, lat double, lon double, closure_rate double, "
                             "mean_impact double, risk_level string, top_cause string").option("header", True).csv(path)
    return back.select("time_slice", "cluster_id", "size", "risk_level")


@query("write_spatial_feature", on_spatial(
    f", n AS (SELECT a.id, count(*) AS c FROM sp a JOIN sp b ON {_BAND} WHERE b.closure = 1 AND {_NEAR} <= 500 GROUP BY 1) "
    "SELECT count(*) AS n, round(avg(coalesce(c, 0)), 6) AS mean_nearby, max(coalesce(c, 0)) AS max_nearby FROM sp LEFT JOIN n USING (id)"))
def write_spatial_feature(spark, sf):
    path = new_folder(spark, "closure-feature")
    N.nearby_closure_share(spatial(spark, sf).select("id", "lat", "lon", "closure")).select(
        "id", "closures", "historical_nearby_closure_rate").write.parquet(path)
    return spark.read.parquet(path).agg(
        F.count("*").alias("n"), F.round(F.avg("closures"), 6).alias("mean_nearby"), F.max("closures").alias("max_nearby"))


# -------------------------------------------------------------------- density
_DY, _DX = f"{D.DY!r}::DOUBLE", f"{D.DX!r}::DOUBLE"
KDE_SQL = SPATIAL_SQL + f""", w0 AS (SELECT 'full' AS filter_kind, 'all' AS filter_value, count(*) AS n FROM sp
 UNION ALL SELECT 'time_band', b, (SELECT count(*) FROM sp WHERE time_band = b) FROM (VALUES ('early_morning'), ('evening'), ('late_night'), ('off_peak')) v(b)
 UNION ALL (SELECT 'cause', cause, count(*) AS n FROM sp GROUP BY cause ORDER BY n DESC, cause LIMIT 6)),
wt AS (SELECT *, NOT (filter_kind = 'time_band' AND n < 20) AS computed FROM w0),
each AS MATERIALIZED (SELECT w.filter_kind, w.filter_value, lat, lon, impact_score::DOUBLE AS w FROM sp JOIN wt w ON computed AND (filter_kind = 'full' OR (filter_kind = 'time_band' AND filter_value = time_band)
 OR (filter_kind = 'cause' AND filter_value = cause))),
m0 AS (SELECT filter_kind, filter_value, sum(w) AS sw, sum(w * w) AS sw2, sum(w * lat) / sum(w) AS my, sum(w * lon) / sum(w) AS mx FROM each GROUP BY 1, 2),
mo AS (SELECT e.filter_kind, e.filter_value, any_value(sw) AS sw, any_value(my) AS mean_lat, any_value(mx) AS mean_lon, sum(w / sw * (lat - my) * (lat - my)) / (1 - any_value(sw2 / (sw * sw))) AS var_lat,
 sum(w / sw * (lon - mx) * (lon - mx)) / (1 - any_value(sw2 / (sw * sw))) AS var_lon, sum(w / sw * (lat - my) * (lon - mx)) / (1 - any_value(sw2 / (sw * sw))) AS cov
 FROM each e JOIN m0 USING (filter_kind, filter_value) GROUP BY 1, 2),
ke AS (SELECT *, var_lat * 0.0004 AS a, var_lon * 0.0004 AS b, cov * 0.0004 AS c FROM mo),
kr AS (SELECT *, a * b - c * c AS det, 8 * sqrt(a) AS ry, 8 * sqrt(b) AS rx FROM ke)"""
GRID_SQL = KDE_SQL + f""", ys AS (SELECT filter_kind, filter_value, lat, lon, w, a, b, c, det, rx, sw, unnest(range(CAST(greatest(ceil((lat - ry - 12.8) / {_DY}), 0) AS BIGINT), CAST(least(floor((lat + ry - 12.8) / {_DY}), 199) AS BIGINT) + 1)) AS iy
 FROM each JOIN kr USING (filter_kind, filter_value)),
xs AS (SELECT *, unnest(range(CAST(greatest(ceil((lon - rx - 77.31) / {_DX}), 0) AS BIGINT), CAST(least(floor((lon + rx - 77.31) / {_DX}), 199) AS BIGINT) + 1)) AS ix FROM ys),
ex AS (SELECT filter_kind, filter_value, iy, ix, w / (2 * pi() * sqrt(det) * sw) AS g, 0.5 * ((iy * {_DY} + 12.8 - lat) ** 2 * b / det + (ix * {_DX} + 77.31 - lon) ** 2 * a / det
 - 2 * (iy * {_DY} + 12.8 - lat) * (ix * {_DX} + 77.31 - lon) * c / det) AS half FROM xs),
su AS (SELECT filter_kind, filter_value, iy, ix, sum(g * exp(-half)) AS d FROM ex WHERE half <= 32 GROUP BY 1, 2, 3, 4),
al AS (SELECT wt.filter_kind, wt.filter_value, y.i AS iy, x.i AS ix FROM wt, range(200) y(i), range(200) x(i)),
gd AS (SELECT al.*, coalesce(d, 0) AS density FROM al LEFT JOIN su USING (filter_kind, filter_value, iy, ix)),
gr AS MATERIALIZED (SELECT gd.*, (density - lo) / greatest(hi - lo, 1e-10) AS intensity FROM gd JOIN (SELECT filter_kind, filter_value, min(density) AS lo, max(density) AS hi FROM gd GROUP BY 1, 2) USING (filter_kind, filter_value))"""


def grid(spark, sf):
    return artefact(spark, sf, "density-grid", lambda: D.density_grid(spatial(spark, sf)))


@query("weighted_moments", KDE_SQL + " SELECT filter_kind, filter_value, round(mean_lat, 6) AS mean_lat, round(mean_lon, 6) AS mean_lon, round(var_lat, 8) AS var_lat, round(var_lon, 8) AS var_lon, round(cov, 8) AS cov FROM mo")
def weighted_moments(spark, sf):
    sp = spatial(spark, sf)
    m = D.weighted_moments(D.by_surface(D.merged_points(sp), D.surfaces(sp)))
    return m.select(*D.SURFACE, *[F.round(c, 6).alias(c) for c in ("mean_lat", "mean_lon")],
                    *[F.round(c, 8).alias(c) for c in ("var_lat", "var_lon", "cov")])


@query("weighted_kde", GRID_SQL + " SELECT filter_kind, filter_value, iy AS lat_idx, ix AS lon_idx, round(intensity, 6) AS intensity FROM gr")
def weighted_kde(spark, sf):
    return grid(spark, sf).select(*D.SURFACE, "lat_idx", "lon_idx", F.round("intensity", 6).alias("intensity"))


@query("density_cross", GRID_SQL + " SELECT filter_kind, filter_value, count(*) AS cells, round(sum(d), 2) AS total FROM su GROUP BY 1, 2")
def density_cross(spark, sf):
    sp = spatial(spark, sf)
    each = D.by_surface(D.merged_points(sp), D.surfaces(sp)).persist()
    sums = D.density_sums(each, D.kernels(D.weighted_moments(each)))
    return sums.groupBy(*D.SURFACE).agg(F.count("*").alias("cells"), F.round(F.sum("density"), 2).alias("total"))


@query("density_filter", GRID_SQL + " SELECT 'accident' AS cause, 'evening' AS time_band, round(sum(intensity), 3) AS total FROM gr WHERE filter_value = 'accident' "
       "UNION ALL SELECT 'no such cause', 'evening', round(sum(intensity), 3) FROM gr WHERE filter_value = 'evening' "
       "UNION ALL SELECT 'no such cause', 'noon', round(sum(intensity), 3) FROM gr WHERE filter_value = 'all'")
def density_filter(spark, sf):
    g, out = grid(spark, sf), None
    for cause, band in (("accident", "evening"), ("no such cause", "evening"), ("no such cause", "noon")):
        one = D.density_filter(g, cause, band).agg(F.round(F.sum("intensity"), 3).alias("total")).select(
            F.lit(cause).alias("cause"), F.lit(band).alias("time_band"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("min_density_rows", KDE_SQL + " SELECT filter_kind, filter_value, n, computed FROM wt")
def min_density_rows(spark, sf):
    return D.surfaces(spatial(spark, sf)).select(*D.SURFACE, "n", "computed")


_HOT = " FROM gr WHERE filter_kind = 'full' AND iy < 199 AND ix < 199 AND intensity > 0.05 * (SELECT max(intensity) FROM gr WHERE filter_kind = 'full')"


@query("hot_cells", GRID_SQL + " SELECT iy AS lat_idx, ix AS lon_idx, round(intensity, 6) AS normalised" + _HOT)
def hot_cells(spark, sf):
    return D.hot_cells(D.density_filter(grid(spark, sf))).select("lat_idx", "lon_idx", F.round("normalised", 6).alias("normalised"))


@query("cell_polygon", GRID_SQL + f" SELECT iy AS lat_idx, ix AS lon_idx, 5 AS points, round(ix * {_DX} + 77.31, 6) AS west, round((iy + 1) * {_DY} + 12.8, 6) AS north" + _HOT)
def cell_polygon(spark, sf):
    return D.hot_cells(D.density_filter(grid(spark, sf))).select(
        "lat_idx", "lon_idx", F.size("ring").alias("points"), F.round(F.col("ring")[0][0], 6).alias("west"),
        F.round(F.col("ring")[2][1], 6).alias("north"))


@query("write_density_grid", GRID_SQL + " SELECT filter_kind, count(*) AS cells, round(sum(intensity), 3) AS total FROM gr GROUP BY 1")
def write_density_grid(spark, sf):
    path = new_folder(spark, "density-out")
    H.write_density(grid(spark, sf), path)
    return spark.read.parquet(path).groupBy("filter_kind").agg(F.count("*").alias("cells"), F.round(F.sum("intensity"), 3).alias("total"))


@query("density_at_points", GRID_SQL + POINTS_SQL + """, fk AS (SELECT * FROM kr WHERE filter_kind = 'full'),
ps AS (SELECT point_id, sum(e.w / (2 * pi() * sqrt(det) * sw) * exp(-h)) AS d FROM (SELECT pt.point_id, e.w, det, sw, 0.5 * ((pt.lat - e.lat) ** 2 * b / det + (pt.lon - e.lon) ** 2 * a / det
 - 2 * (pt.lat - e.lat) * (pt.lon - e.lon) * c / det) AS h FROM pt, fk, (SELECT * FROM each WHERE filter_kind = 'full') e WHERE abs(pt.lat - e.lat) <= ry AND abs(pt.lon - e.lon) <= rx) e WHERE h <= 32 GROUP BY 1)
SELECT pt.point_id, pt.lat, pt.lon, round(least(coalesce(d, 0) / (SELECT max(density) FROM gr WHERE filter_kind = 'full'), 1), 4) AS density_score FROM pt LEFT JOIN ps USING (point_id)""")
def density_at_points(spark, sf):
    merged = artefact(spark, sf, "density-points", lambda: D.merged_points(spatial(spark, sf)))
    full = artefact(spark, sf, "density-full", lambda: D.density_grid(merged, kinds=("full",)))
    return D.density_at_points(query_points(spark, sf), merged, D.peak_density(full))
