"""Baselines, spikes, isolation forest and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from roadwatch.functions import columns as C
from roadwatch.operators import anomaly as A
from roadwatch.plans.registry import artefact, feed, incidents, on_incidents, query
from roadwatch.session import new_folder
from roadwatch.streaming import replay as T

DAYS = 20   # the feed spans 30 days

_CH = "SELECT coalesce(corridor, 'Non-corridor') AS corridor, CAST(hour(start_datetime) AS INTEGER) AS hour"
PARTS_SQL = (", cut AS (SELECT min(start_datetime) + INTERVAL 20 DAY AS t FROM incidents), "
             f"base AS ({_CH}, count(*) AS event_count FROM incidents, cut WHERE start_datetime < t GROUP BY 1, 2), "
             f"based AS ({_CH}, CAST(start_datetime AS DATE) AS day, count(*) AS event_count FROM incidents, cut WHERE start_datetime < t GROUP BY 1, 2, 3), "
             f"live AS ({_CH}, CAST(start_datetime AS DATE) AS day, count(*) AS event_count FROM incidents, cut WHERE start_datetime >= t GROUP BY 1, 2, 3)")


def on_parts(sql):
    return on_incidents(PARTS_SQL + " " + sql).replace(") , cut", "), cut")


def spike_sql(source, extra=""):
    return on_parts(f"SELECT live.*, event_count < lo OR event_count > hi AS is_anomaly FROM live, "
                    f"(SELECT quantile_cont(event_count, 0.025) AS lo, quantile_cont(event_count, 0.975) AS hi FROM {source}){extra}")


def counts(spark, sf):
    inc = incidents(spark, sf)
    return A.baseline_counts(inc, DAYS), A.live_counts(inc, DAYS)


@query("corridor_hour_counts", on_parts("SELECT * FROM base"))
def corridor_hour_counts(spark, sf):
    return counts(spark, sf)[0]


@query("daily_corridor_hour_counts", on_parts("SELECT * FROM live"))
def daily_corridor_hour_counts(spark, sf):
    return counts(spark, sf)[1]


@query("quantile_spikes", spike_sql("base"))
def quantile_spikes(spark, sf):
    base, live = counts(spark, sf)
    return A.quantile_spikes(live, A.spike_bounds(base))


@query("quantile_spikes_per_day", spike_sql("based"))
def quantile_spikes_per_day(spark, sf):
    base = A.baseline_counts(incidents(spark, sf), DAYS, per_day=True)
    return A.quantile_spikes(counts(spark, sf)[1], A.spike_bounds(base))


@query("anomaly_summary", spike_sql("based").replace(
    "SELECT live.*, event_count < lo OR event_count > hi AS is_anomaly FROM",
    "SELECT count(*) AS total_points, count(*) FILTER (WHERE event_count < lo OR event_count > hi) AS anomaly_count, "
    "count(*) FILTER (WHERE NOT (event_count < lo OR event_count > hi)) AS normal_count, "
    "round(avg(CASE WHEN event_count < lo OR event_count > hi THEN 1 ELSE 0 END), 6) AS anomaly_rate FROM"))
def anomaly_summary(spark, sf):
    return A.anomaly_summary(quantile_spikes_per_day(spark, sf))


#: whole-period totals as requests; some are spoilt in every way that is refused: by corridor, hour and count
_REQUESTS = (", req AS (SELECT CASE WHEN hour = 3 THEN NULL WHEN hour = 4 THEN '  ' ELSE corridor END AS corridor, "
             "CASE WHEN hour = 5 THEN '24' WHEN hour = 6 THEN '-1' WHEN hour = 7 THEN 'noon' WHEN hour = 8 THEN '8.5' ELSE CAST(hour AS VARCHAR) END AS hour, "
             "CASE WHEN hour = 9 THEN '-' || CAST(n AS VARCHAR) WHEN hour = 10 THEN NULL WHEN hour = 11 THEN CAST(n AS VARCHAR) || '.0' ELSE CAST(n AS VARCHAR) END AS event_count "
             "FROM (SELECT corridor, hour, CAST(sum(event_count) AS BIGINT) AS n FROM live GROUP BY 1, 2)), "
             "judged AS (SELECT *, CASE WHEN coalesce(trim(corridor), '') = '' THEN 'corridor is missing' "
             "WHEN TRY_CAST(hour AS DOUBLE) IS NULL OR TRY_CAST(hour AS DOUBLE) NOT BETWEEN 0 AND 23 OR TRY_CAST(hour AS DOUBLE) <> floor(TRY_CAST(hour AS DOUBLE)) "
             "THEN 'hour is not a whole number from 0 to 23' "
             "WHEN TRY_CAST(event_count AS DOUBLE) IS NULL OR TRY_CAST(event_count AS DOUBLE) < 0 THEN 'event_count is not a whole number from 0' END AS problem FROM req)")


def requests(spark, sf):
    """A request batch as text columns, part of it invalid."""
    total = counts(spark, sf)[1].groupBy("corridor", "hour").agg(F.sum("event_count").alias("n"))
    hour, n = F.col("hour"), F.col("n").cast("string")
    return total.select(
        F.when(hour == 3, None).when(hour == 4, "  ").otherwise(F.col("corridor")).alias("corridor"),
        F.when(hour == 5, "24").when(hour == 6, "-1").when(hour == 7, "noon").when(hour == 8, "8.5").otherwise(hour.cast("string")).alias("hour"),
        F.when(hour == 9, F.concat(F.lit("-"), n)).when(hour == 10, None).when(hour == 11, F.concat(n, F.lit(".0"))).otherwise(n).alias("event_count"))


@query("score_request_batch", on_parts("").rstrip() + _REQUESTS + " SELECT corridor, CAST(CAST(hour AS DOUBLE) AS INTEGER) AS hour, CAST(CAST(event_count AS DOUBLE) AS BIGINT) AS event_count, "
       "CAST(event_count AS DOUBLE) < lo OR CAST(event_count AS DOUBLE) > hi AS is_anomaly "
       "FROM judged, (SELECT quantile_cont(event_count, 0.025) AS lo, quantile_cont(event_count, 0.975) AS hi FROM based) WHERE problem IS NULL")
def score_request_batch(spark, sf):
    """Any table with corridor, hour and event_count can be scored; here whole-period totals, the invalid ones left out."""
    base = A.baseline_counts(incidents(spark, sf), DAYS, per_day=True)
    return A.quantile_spikes(A.split_requests(requests(spark, sf))[0], A.spike_bounds(base))


@query("refused_requests", on_parts("").rstrip() + _REQUESTS + " SELECT * FROM judged WHERE problem IS NOT NULL")
def refused_requests(spark, sf):
    """The rest of the batch, each row with the reason."""
    return A.split_requests(requests(spark, sf))[1]


@query("score_request_forest")
def score_request_forest(spark, sf):
    """The valid requests with the forest's verdict and confidence."""
    base = counts(spark, sf)[0]
    fitted = leaves(spark, sf)
    return A.forest_detect(A.split_requests(requests(spark, sf))[0], fitted, A.forest_offset(base, fitted))


def leaves(spark, sf):
    return artefact(spark, sf, "forest-leaves", lambda: A.fit_forest(counts(spark, sf)[0]))


@query("isolation_forest_fit")
def isolation_forest_fit(spark, sf):
    return leaves(spark, sf).select("tree", "lo", "hi", F.round("path_len", 6).alias("path_len"), "sample_size")


_LEAVES = (", lf AS (SELECT hour AS tree, CAST(lag(event_count) OVER w AS DOUBLE) AS lo, CAST(CASE WHEN lead(event_count) OVER w IS NULL THEN 'infinity' ELSE event_count::VARCHAR END AS DOUBLE) AS hi, "
           "row_number() OVER w AS path_len FROM (SELECT DISTINCT hour, event_count FROM based) WINDOW w AS (PARTITION BY hour ORDER BY event_count))")


@query("leaf_range_join", on_parts("").rstrip() + _LEAVES + " SELECT v.event_count, round(sum(path_len) / (SELECT count(DISTINCT tree) FROM lf)::DOUBLE, 6) AS mean_path "
       "FROM (SELECT DISTINCT event_count FROM live) v JOIN lf ON (lo IS NULL OR lo < v.event_count) AND v.event_count <= hi GROUP BY 1")
def leaf_range_join(spark, sf):
    """Interval lookup on leaves anyone can write down: per hour, the steps between baseline counts."""
    base = A.baseline_counts(incidents(spark, sf), DAYS, per_day=True).select(F.col("hour").alias("tree"), "event_count").distinct()
    w = Window.partitionBy("tree").orderBy("event_count")
    steps = base.select(
        "tree", F.coalesce(F.lag("event_count").over(w).cast("double"), F.lit(float("-inf"))).alias("lo"),
        F.when(F.lead("event_count").over(w).isNull(), float("inf")).otherwise(F.col("event_count").cast("double")).alias("hi"),
        F.row_number().over(w).cast("double").alias("path_len"), F.lit(256).alias("sample_size"))
    out = A.leaf_range_join(counts(spark, sf)[1], steps.persist())
    return out.select("event_count", F.round("mean_path", 6).alias("mean_path"))


@query("isolation_forest_score")
def isolation_forest_score(spark, sf):
    base, live = counts(spark, sf)
    fitted = leaves(spark, sf)
    return A.forest_detect(live, fitted, A.forest_offset(base, fitted))


_PVA = (", log AS (SELECT id AS incident_id, CASE WHEN lower(trim(event_cause)) = 'vehicle_breakdown' THEN 'High' ELSE 'Low' END AS predicted_priority, "
        "requires_road_closure AS predicted_closure, 2.0::DOUBLE AS predicted_duration, coalesce(priority, 'Low') AS actual_priority, "
        "requires_road_closure AS actual_closure FROM incidents)")
_LIVE_PVA = ", cut AS (SELECT min(start_datetime) + INTERVAL 20 DAY AS t FROM incidents)" + _PVA.replace("FROM incidents)", "FROM incidents, cut WHERE start_datetime >= t)")


def with_clean_causes(inc):
    return inc.withColumn("event_cause", C.tidy("event_cause"))


@query("predicted_vs_actual", on_incidents(_PVA + " SELECT * FROM log").replace(") , log", "), log"))
def predicted_vs_actual(spark, sf):
    return A.predicted_vs_actual(with_clean_causes(incidents(spark, sf)))


@query("accuracy_metrics", on_incidents(_PVA + ", d AS (SELECT log.*, (epoch_us(closed_datetime) - epoch_us(start_datetime)) / 3600000000.0::DOUBLE AS actual_duration "
       "FROM log JOIN incidents ON id = incident_id) SELECT count(*) AS n, round(avg(CAST(predicted_closure = actual_closure AS INTEGER)), 6) AS closure_accuracy, "
       "round(avg(CAST(predicted_priority = actual_priority AS INTEGER)), 6) AS priority_accuracy, round(avg(abs(predicted_duration - actual_duration)), 6) AS duration_mae FROM d").replace(") , log", "), log"))
def accuracy_metrics(spark, sf):
    inc = incidents(spark, sf)
    hours = inc.select("id", ((F.unix_micros("closed_datetime") - F.unix_micros("start_datetime")) / 3.6e9).alias("actual_duration"))
    log = A.predicted_vs_actual(with_clean_causes(inc))
    return A.accuracy_metrics(log.join(hours, log.incident_id == hours.id))


# -------------------------------------------------------------------- streaming
_BY_DAY = "SELECT CAST(start_datetime AS DATE) AS day, count(*) AS n FROM incidents GROUP BY 1"
_HOURLY = (", f AS (SELECT date_trunc('hour', start_datetime) AS hour_start, coalesce(corridor, 'Non-corridor') AS corridor, "
           "CAST(hour(start_datetime) AS INTEGER) AS hour, count(*) AS event_count FROM incidents, cut WHERE start_datetime >= t GROUP BY 1, 2, 3)")


def publish_live(spark, sf):
    """Folder of the part of the feed from the cutoff on; the cutoff is one number fixed at the start."""
    first = incidents(spark, sf).agg(F.min("start_datetime") + F.expr(f"INTERVAL {DAYS} DAYS")).first()[0]
    path = new_folder(spark, "live-by-day")
    T.publish_feed(feed(spark, sf).filter(F.col("ts").cast("timestamp") >= F.lit(first)), path)
    return path


def live_hours(spark, sf):
    """Hourly counts of the live part as a finished feed."""
    path = publish_live(spark, sf)
    T.close_feed(spark, path)
    return T.hourly_counts(T.replay_source(spark, path))


def _sink(spark, stream, name):
    out = new_folder(spark, name)
    T.run_to_end(stream, out, new_folder(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


@query("replay_source", on_incidents(_BY_DAY))
def replay_source(spark, sf):
    path = new_folder(spark, "feed-by-day")
    T.publish_feed(feed(spark, sf), path)
    return _sink(spark, T.replay_source(spark, path), "replayed").groupBy(F.to_date("start_datetime").alias("day")).agg(F.count("*").alias("n"))


@query("replay_stream", on_parts("SELECT id, start_datetime, event_cause FROM incidents, cut WHERE start_datetime >= t"))
def replay_stream(spark, sf):
    """Replay of the live part, a few files at a time."""
    live = T.replay_source(spark, publish_live(spark, sf), files_per_trigger=4)
    return _sink(spark, live.select("id", "start_datetime", "event_cause"), "live-replay")


@query("stream_corridor_hour_counts", on_parts("").rstrip() + _HOURLY + " SELECT * FROM f")
def stream_corridor_hour_counts(spark, sf):
    return _sink(spark, live_hours(spark, sf), "hourly")


@query("stream_spikes", on_parts("").rstrip() + _HOURLY +
       " SELECT f.*, TRUE AS is_anomaly FROM f, (SELECT quantile_cont(event_count, 0.025) AS lo, quantile_cont(event_count, 0.975) AS hi FROM based) q WHERE event_count < lo OR event_count > hi")
def stream_spikes(spark, sf):
    base = A.baseline_counts(incidents(spark, sf), DAYS, per_day=True)
    lo, hi = base.agg(F.percentile("event_count", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    return _sink(spark, T.spikes(live_hours(spark, sf), lo, hi), "spikes")


@query("stream_forest_flags")
def stream_forest_flags(spark, sf):
    """Hourly counts of the live part scored by the forest inside the stream; the same verdicts as ``isolation_forest_score``."""
    base, fitted = counts(spark, sf)[0], leaves(spark, sf)
    table = A.ForestTable(fitted, base.agg(F.lit(1)).select(A.forest_offset(base, fitted)).first()[0])
    return _sink(spark, table.flag(live_hours(spark, sf)), "forest-flags")


@query("stream_accuracy_log", on_incidents(_LIVE_PVA + " SELECT count(*) AS n, round(avg(CAST(predicted_closure = actual_closure AS INTEGER)), 6) AS closure_accuracy, "
       "round(avg(CAST(predicted_priority = actual_priority AS INTEGER)), 6) AS priority_accuracy, CAST(NULL AS DOUBLE) AS duration_mae FROM log").replace(") , cut", "), cut"))
def stream_accuracy_log(spark, sf):
    live = with_clean_causes(T.replay_source(spark, publish_live(spark, sf)))
    return A.accuracy_metrics(_sink(spark, T.accuracy_log(live), "accuracy"))


_OUTCOMES = (", o AS (SELECT log.*, CASE WHEN closed_datetime >= start_datetime AND closed_datetime <= start_datetime + INTERVAL 24 HOUR "
             "THEN (epoch_us(closed_datetime) - epoch_us(start_datetime)) / 3600000000.0::DOUBLE END AS actual_duration FROM log JOIN incidents ON id = incident_id)")


def outcomes(spark, sf):
    """Log of the live part with the closings as a second stream; both feeds are finished."""
    live, ends = publish_live(spark, sf), new_folder(spark, "closings-by-day")
    T.publish_closings(incidents(spark, sf), ends)
    T.close_outcomes(spark, live, ends)
    return _sink(spark, T.outcome_log(with_clean_causes(T.replay_source(spark, live)), T.closing_source(spark, ends)), "outcomes")


@query("stream_outcome_log", on_incidents(_LIVE_PVA + _OUTCOMES + " SELECT * REPLACE (round(actual_duration, 6) AS actual_duration) FROM o").replace(") , cut", "), cut"))
def stream_outcome_log(spark, sf):
    return outcomes(spark, sf).withColumn("actual_duration", F.round("actual_duration", 6))


@query("stream_outcome_accuracy", on_incidents(_LIVE_PVA + _OUTCOMES + " SELECT count(*) AS n, round(avg(CAST(predicted_closure = actual_closure AS INTEGER)), 6) AS closure_accuracy, "
       "round(avg(CAST(predicted_priority = actual_priority AS INTEGER)), 6) AS priority_accuracy, "
       "round(avg(abs(predicted_duration - actual_duration)), 6) AS duration_mae FROM o").replace(") , cut", "), cut"))
def stream_outcome_accuracy(spark, sf):
    """Accuracy with the duration error that a replay without closings can't know."""
    return A.accuracy_metrics(outcomes(spark, sf))


@query("stream_checkpoint", on_incidents(_BY_DAY))
def stream_checkpoint(spark, sf):
    """Two runs over a growing feed share a checkpoint: the second reads only the new files."""
    path, out, state = (new_folder(spark, n) for n in ("growing-feed", "growing-out", "growing-state"))
    rows = feed(spark, sf)
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle)):
        T.publish_feed(part, path)
        stream = T.replay_source(spark, path).select("id", "start_datetime")
        T.run_to_end(stream, out, state)
    return spark.read.parquet(out).groupBy(F.to_date("start_datetime").alias("day")).agg(F.count("*").alias("n"))
