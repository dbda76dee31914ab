"""Corridor statistics, risk and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators import corridor as K
from roadwatch.plans.registry import SPATIAL_SQL, incidents, on_spatial, query, spatial

STATS_SQL = SPATIAL_SQL + """, tot AS (SELECT corridor, count(*) AS event_count, avg(closure) AS closure_rate,
 avg(is_high_priority) AS high_priority_rate, avg(impact_score) AS mean_impact, CAST(sum(impact_score) AS BIGINT) AS total_impact FROM sp GROUP BY 1),
ph AS (SELECT corridor, hour AS peak_hour FROM (SELECT corridor, hour, row_number() OVER (PARTITION BY corridor ORDER BY count(*) DESC, hour) AS r FROM sp GROUP BY 1, 2) WHERE r = 1),
dc AS (SELECT corridor, cause AS dominant_cause FROM (SELECT corridor, cause, row_number() OVER (PARTITION BY corridor ORDER BY count(*) DESC, cause) AS r FROM sp GROUP BY 1, 2) WHERE r = 1),
cs AS (SELECT * FROM tot JOIN ph USING (corridor) JOIN dc USING (corridor))"""
RISK_SQL = STATS_SQL + """, kept AS (SELECT * FROM cs WHERE event_count >= 10),
b AS (SELECT min(closure_rate) AS c0, max(closure_rate) AS c1, min(mean_impact) AS i0, max(mean_impact) AS i1, min(event_count) AS v0, max(event_count) AS v1 FROM kept),
cr0 AS (SELECT kept.*, round(0.4::DOUBLE * coalesce((closure_rate - c0) / nullif(c1 - c0, 0), 0) + 0.4::DOUBLE * coalesce((mean_impact - i0) / nullif(i1 - i0, 0), 0)
 + 0.2::DOUBLE * coalesce((event_count - v0) / nullif(v1 - v0, 0)::DOUBLE, 0), 4) AS risk_score FROM kept, b),
cr AS (SELECT *, CASE WHEN risk_score < 0.33 THEN 'LOW' WHEN risk_score < 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM cr0)"""
PUB = ("corridor, event_count, round(closure_rate, 4) AS closure_rate, round(mean_impact, 2) AS mean_impact, "
       "peak_hour, risk_score, risk_tier, dominant_cause")


def stats(spark, sf):
    return K.corridor_stats(spatial(spark, sf))


def risk(spark, sf, n=S.MIN_CORRIDOR_EVENTS):
    return K.corridor_risk(spatial(spark, sf), n)


@query("corridor_stats", STATS_SQL + """ SELECT corridor, event_count, round(closure_rate, 6) AS closure_rate, round(high_priority_rate, 6) AS high_priority_rate,
 round(mean_impact, 6) AS mean_impact, total_impact, peak_hour, dominant_cause FROM cs""")
def corridor_stats(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("closure_rate", "high_priority_rate", "mean_impact")}
    return stats(spark, sf).withColumns(rounded)


@query("corridor_risk", RISK_SQL + f" SELECT {PUB} FROM cr")
def corridor_risk(spark, sf):
    return K.published(risk(spark, sf))


@query("rank_corridors", RISK_SQL + f" SELECT row_number() OVER (ORDER BY risk_score DESC, corridor) AS risk_rank, {PUB} FROM cr")
def rank_corridors(spark, sf):
    return K.rank_corridors(K.published(risk(spark, sf)))


@query("min_events", STATS_SQL + " SELECT corridor, event_count, m.min_events FROM cs, (VALUES (0), (5), (10), (500)) m(min_events) WHERE event_count >= m.min_events")
def min_events(spark, sf):
    levels = F.explode(F.array(*[F.lit(n) for n in (0, 5, 10, 500)]))
    return (stats(spark, sf).select("corridor", "event_count", levels.alias("min_events"))
            .filter(F.col("event_count") >= F.col("min_events")))


@query("minmax_scale", STATS_SQL + """ SELECT corridor, round(coalesce((closure_rate - (SELECT min(closure_rate) FROM cs)) /
 nullif((SELECT max(closure_rate) - min(closure_rate) FROM cs), 0), 0), 6) AS closure_scaled, 0.0::DOUBLE AS constant_scaled FROM cs""")
def minmax_scale(spark, sf):
    df = stats(spark, sf).withColumn("one", F.lit(1))
    out = K.minmax_scale(df, {"closure_rate": "closure_scaled", "one": "constant_scaled"})
    return out.select("corridor", F.round("closure_scaled", 6).alias("closure_scaled"), "constant_scaled")


@query("peak_hour", STATS_SQL + " SELECT corridor, peak_hour FROM ph")
def peak_hour(spark, sf):
    by_hour = spatial(spark, sf).groupBy("corridor", "hour").agg(F.count("*").alias("n"))
    return K.top_value(by_hour, ["corridor"], "hour", "n", "peak_hour")


@query("dominant_value", STATS_SQL + " SELECT corridor, dominant_cause FROM dc")
def dominant_value(spark, sf):
    by_cause = spatial(spark, sf).groupBy("corridor", "cause").agg(F.count("*").alias("n"))
    return K.top_value(by_cause, ["corridor"], "cause", "n", "dominant_cause")


@query("bucket_tier", RISK_SQL + " SELECT corridor, risk_score, risk_tier FROM cr")
def bucket_tier(spark, sf):
    return risk(spark, sf).select("corridor", "risk_score", "risk_tier")


@query("named_corridors", RISK_SQL + f" SELECT {PUB} FROM cr WHERE corridor <> 'non-corridor'")
def named_corridors(spark, sf):
    return K.published(risk(spark, sf)).filter(F.col("corridor") != "non-corridor")


@query("corridor_table", RISK_SQL + f" SELECT {PUB} FROM cr ORDER BY risk_score DESC, corridor LIMIT 20")
def corridor_table(spark, sf):
    return K.published(risk(spark, sf)).orderBy(F.desc("risk_score"), "corridor").limit(20)


@query("top_corridors", RISK_SQL + " SELECT corridor, risk_score, risk_tier FROM cr ORDER BY risk_score DESC, corridor LIMIT 8")
def top_corridors(spark, sf):
    return risk(spark, sf).select("corridor", "risk_score", "risk_tier").orderBy(F.desc("risk_score"), "corridor").limit(8)


@query("top_by_volume", RISK_SQL + " SELECT corridor, event_count, risk_tier FROM cr ORDER BY event_count DESC, corridor LIMIT 15")
def top_by_volume(spark, sf):
    return risk(spark, sf).select("corridor", "event_count", "risk_tier").orderBy(F.desc("event_count"), "corridor").limit(15)


@query("events_by_dominant_cause", RISK_SQL + " SELECT replace(dominant_cause, '_', ' ') AS cause, CAST(sum(event_count) AS BIGINT) AS events FROM cr GROUP BY 1 ORDER BY 2 DESC, 1")
def events_by_dominant_cause(spark, sf):
    return (risk(spark, sf).groupBy(F.regexp_replace("dominant_cause", "_", " ").alias("cause"))
            .agg(F.sum("event_count").alias("events")).orderBy(F.desc("events"), "cause"))


@query("peak_hour_histogram", RISK_SQL + " SELECT CAST(h AS INTEGER) AS peak_hour, (SELECT count(*) FROM cr WHERE cr.peak_hour = h) AS corridors FROM range(24) t(h)")
def peak_hour_histogram(spark, sf):
    counts = risk(spark, sf).groupBy("peak_hour").agg(F.count("*").alias("corridors"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("peak_hour"))
    return hours.join(counts, "peak_hour", "left").fillna(0, ["corridors"])


@query("tier_counts", RISK_SQL + " SELECT risk_tier, count(*) AS corridors, CAST(sum(event_count) AS BIGINT) AS events FROM cr GROUP BY 1")
def tier_counts(spark, sf):
    return risk(spark, sf).groupBy("risk_tier").agg(F.count("*").alias("corridors"), F.sum("event_count").alias("events"))


@query("event_total", RISK_SQL + " SELECT CAST(sum(event_count) AS BIGINT) AS events, count(*) FILTER (WHERE risk_tier = 'HIGH') AS high, "
       "count(*) FILTER (WHERE risk_tier = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_tier = 'LOW') AS low FROM cr")
def event_total(spark, sf):
    tier = F.col("risk_tier")
    return risk(spark, sf).agg(
        F.sum("event_count").alias("events"), F.count_if(tier == "HIGH").alias("high"),
        F.count_if(tier == "MEDIUM").alias("medium"), F.count_if(tier == "LOW").alias("low"))


@query("closure_hotlist", on_spatial(
    "SELECT corridor, count(*) AS event_count, round(avg(closure), 6) AS closure_rate, "
    "round(avg(closure) / (SELECT avg(closure) FROM sp), 6) AS lift FROM sp GROUP BY 1 HAVING count(*) >= 30"))
def closure_hotlist(spark, sf):
    return K.closure_hotlist(spatial(spark, sf)).withColumns(
        {"closure_rate": F.round("closure_rate", 6), "lift": F.round("lift", 6)})


# Lookup of published corridor risk by tidy corridor name, with defaults.
LOOKUP_SQL = RISK_SQL + """, plan AS (SELECT i.id, coalesce(nullif(lower(trim(i.corridor)), ''), 'non-corridor') AS corridor,
 coalesce(cr.risk_tier, 'MEDIUM') AS corridor_risk_tier, coalesce(cr.risk_score, 0.5) AS corridor_risk_score
 FROM incidents i LEFT JOIN (SELECT * FROM cr WHERE risk_score > 0.2) cr ON cr.corridor = lower(trim(i.corridor)))"""


@query("corridor_risk_join", LOOKUP_SQL + " SELECT * FROM plan")
def corridor_risk_join(spark, sf):
    from roadwatch.operators.rules import attach_corridor_risk
    known = risk(spark, sf).filter(F.col("risk_score") > 0.2)
    out = attach_corridor_risk(incidents(spark, sf), known)
    name = C.clean_category("corridor", "non-corridor")
    return out.select("id", name.alias("corridor"), "corridor_risk_tier", "corridor_risk_score")


@query("read_corridor_risk", RISK_SQL + """ SELECT lower(trim(corridor)) AS corridor, event_count, round(closure_rate, 4) AS closure_rate,
 round(mean_impact, 2) AS mean_impact, 12 AS peak_hour, risk_score, risk_tier, dominant_cause FROM cr""")
def read_corridor_risk(spark, sf):
    """Write the corridor document without one field, read it back with defaults."""
    from roadwatch.session import new_folder
    from roadwatch.sources import documents as D
    path = new_folder(spark, "corridor-json")
    D.write_json(D.corridor_document(K.published(risk(spark, sf)).drop("peak_hour"), spatial(spark, sf)), path)
    return D.read_corridor_risk(spark, path)


@query("write_corridor_risk", RISK_SQL + """ SELECT (SELECT count(*) FROM cr) AS total_corridors_ranked, 10 AS min_events_threshold,
 (SELECT round(avg(closure), 4) FROM sp) AS overall_baseline_closure_rate,
 (SELECT round(avg(CASE WHEN corridor = 'non-corridor' THEN 1 ELSE 0 END), 4) FROM sp) AS non_corridor_event_fraction,
 corridor, risk_score FROM cr""")
def write_corridor_risk(spark, sf):
    from roadwatch.session import new_folder
    from roadwatch.sources import documents as D
    path = new_folder(spark, "corridor-json")
    D.write_json(D.corridor_document(K.published(risk(spark, sf)), spatial(spark, sf)), path)
    doc = spark.read.json(path)
    return doc.select(
        "total_corridors_ranked", F.col("min_events_threshold").cast("int").alias("min_events_threshold"),
        "overall_baseline_closure_rate", "non_corridor_event_fraction", F.explode("corridors").alias("c")
    ).select("*", F.col("c.corridor").alias("corridor"), F.col("c.risk_score").alias("risk_score")).drop("c")
