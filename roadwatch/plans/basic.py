"""Cleaning, filtering and counting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators import cleaning
from roadwatch.plans.registry import (
    features, incidents, on_features, on_incidents, on_spatial, query, spatial,
)
from roadwatch.sources.incidents import missing_columns, scan_incidents, conform


# ------------------------------------------------------------------ cleaning
@query("parse_timestamps", on_incidents(
    "SELECT id, start_datetime AS start_ts, TRY_CAST(CASE WHEN id % 7 = 0 THEN 'not a time' "
    "ELSE strftime(start_datetime, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS text_ts FROM incidents"))
def parse_timestamps(spark, sf):
    text = F.when(F.col("id") % 7 == 0, "not a time").otherwise(
        F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss+00"))
    return incidents(spark, sf).select(
        "id", C.parse_timestamp("start_datetime").alias("start_ts"), C.parse_timestamp(text).alias("text_ts"))


@query("time_features", on_features("SELECT id, hour, dow, month FROM ft"))
def time_features(spark, sf):
    return cleaning.with_time(incidents(spark, sf)).select("id", "hour", "dow", "month")


@query("peak_flags", on_features(
    "SELECT id, is_weekend, is_morning_peak, is_evening_peak, is_midday_quiet FROM ft"))
def peak_flags(spark, sf):
    return features(spark, sf).select("id", "is_weekend", "is_morning_peak", "is_evening_peak", "is_midday_quiet")


@query("is_planned", on_features(
    "SELECT id, is_planned, CASE WHEN cause_cat IN ('planned_event','public_event','vip_movement','rally','festival',"
    "'procession','protest') THEN 1 ELSE 0 END AS planned_by_cause FROM ft"))
def is_planned(spark, sf):
    return incidents(spark, sf).select(
        "id", C.is_planned("event_type", "event_cause").alias("is_planned"),
        C.is_planned("event_type", "event_cause", has_type=False).alias("planned_by_cause"))


@query("clean_category", on_incidents(
    "SELECT id, coalesce(nullif(lower(trim(event_cause)), ''), 'unknown') AS cause, "
    "coalesce(nullif(lower(trim(corridor)), ''), 'no_corridor') AS corridor_model, "
    "coalesce(nullif(nullif(lower(trim(corridor)), ''), 'null'), 'non-corridor') AS corridor_spatial, "
    "coalesce(nullif(lower(trim(zone)), ''), 'no_zone') AS zone FROM incidents"))
def clean_category(spark, sf):
    return incidents(spark, sf).select(
        "id", C.clean_category("event_cause", "unknown").alias("cause"),
        C.clean_category("corridor", "no_corridor").alias("corridor_model"),
        C.spatial_category("corridor", "non-corridor").alias("corridor_spatial"),
        C.clean_category("zone", "no_zone").alias("zone"))


@query("coerce_numeric", on_incidents(
    "SELECT id, latitude AS lat, TRY_CAST(route_path AS DOUBLE) AS not_a_number, "
    "TRY_CAST(replace(police_station, 'ps_', '') AS DOUBLE) AS station_no FROM incidents"))
def coerce_numeric(spark, sf):
    return incidents(spark, sf).select(
        "id", C.to_number("latitude").alias("lat"), C.to_number("route_path").alias("not_a_number"),
        C.to_number(F.regexp_replace("police_station", "ps_", "")).alias("station_no"))


@query("end_coord_flag", on_incidents(
    "SELECT id, nullif(endlatitude, 0.0) AS end_lat, nullif(endlongitude, 0.0) AS end_lon, "
    "(nullif(endlatitude, 0.0) IS NOT NULL AND nullif(endlongitude, 0.0) IS NOT NULL) AS has_end_coord FROM incidents"))
def end_coord_flag(spark, sf):
    return cleaning.with_end_coords(incidents(spark, sf)).select("id", "end_lat", "end_lon", "has_end_coord")


@query("coerce_bool", on_incidents(
    "SELECT id, CAST(lower(CAST(requires_road_closure AS VARCHAR)) IN ('true','yes','1','y','t') AS INTEGER) AS closure_wide, "
    "CAST(lower(substr(status, 1, 1)) IN ('true','yes','1','y','t') AS INTEGER) AS letter_wide, "
    "CAST(lower(CAST(requires_road_closure AS VARCHAR)) IN ('true','yes','1') AS INTEGER) AS closure_spatial, "
    "CAST(id % 3 = 1 AS INTEGER) AS digit_rules FROM incidents"))
def coerce_bool(spark, sf):
    return incidents(spark, sf).select(
        "id", C.truth("requires_road_closure", S.TRUTH_WIDE).alias("closure_wide"),
        C.truth(F.substring("status", 1, 1), S.TRUTH_WIDE).alias("letter_wide"),
        C.truth("requires_road_closure", S.TRUTH_SPATIAL).alias("closure_spatial"),
        C.truth(F.col("id") % 3, S.TRUTH_RULES).alias("digit_rules"))


@query("high_priority_flag", on_incidents(
    "SELECT id, CASE WHEN lower(trim(priority)) = 'high' THEN 1 ELSE 0 END AS high FROM incidents"))
def high_priority_flag(spark, sf):
    return incidents(spark, sf).select("id", C.is_high("priority").alias("high"))


@query("time_band", on_spatial("SELECT id, time_band FROM sp"))
def time_band(spark, sf):
    return spatial(spark, sf).select("id", "time_band")


@query("proxy_impact", on_spatial(
    "SELECT id, impact_score, impact_score / 10.0::DOUBLE AS impact_weight, CAST(closure AS DOUBLE) AS closure_probability FROM sp"))
def proxy_impact(spark, sf):
    return spatial(spark, sf).select(
        "id", "impact_score", "impact_weight", F.col("closure").cast("double").alias("closure_probability"))


@query("normalize_request", on_features(
    "SELECT id, cause_cat, corridor_cat, zone_cat, veh_type_cat, police_station_cat, hour, dow, month, "
    "is_weekend, is_morning_peak, is_evening_peak, is_midday_quiet FROM ft"))
def normalize_request(spark, sf):
    requests = incidents(spark, sf).withColumnRenamed("event_cause", "cause")
    out = cleaning.normalize_requests(requests)
    return out.select("id", *S.CATEGORICAL_FEATURES, "hour", "dow", "month",
                      "is_weekend", "is_morning_peak", "is_evening_peak", "is_midday_quiet")


@query("fill_missing_features", on_features(
    "SELECT id, cause_cat, 'unknown' AS zone_cat, hour, 0 AS is_planned FROM ft"))
def fill_missing_features(spark, sf):
    thin = features(spark, sf).select("id", "cause_cat", "hour")
    return cleaning.fill_missing_features(thin).select("id", "cause_cat", "zone_cat", "hour", "is_planned")


@query("extract_hour", on_incidents(
    "SELECT id, CAST(hour(start_datetime) AS INTEGER) AS from_iso, CAST(hour(start_datetime) AS INTEGER) AS from_text, "
    "12 AS from_nothing FROM incidents"))
def extract_hour(spark, sf):
    return incidents(spark, sf).select(
        "id", C.hour_from_text(F.date_format("start_datetime", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_iso"),
        C.hour_from_text(F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss.SSS+00")).alias("from_text"),
        C.hour_from_text(F.date_format("start_datetime", "yyyy-MM-dd")).alias("from_nothing"))


@query("nan_to_null", on_incidents(
    "SELECT id, CASE WHEN id % 5 <> 0 THEN latitude END AS lat, coalesce(CASE WHEN id % 5 <> 0 THEN id END, 0) AS n FROM incidents"))
def nan_to_null(spark, sf):
    inc = incidents(spark, sf)
    noisy = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("latitude"))
    return inc.select("id", C.nan_to_null(noisy).alias("lat"),
                      F.coalesce(F.when(F.col("id") % 5 != 0, F.col("id")), F.lit(0)).alias("n"))


@query("cause_group", on_spatial(
    "SELECT id, CASE WHEN cause IN ('vehicle_breakdown','accident','pot_holes','construction','water_logging',"
    "'tree_fall','congestion','others') THEN cause ELSE 'other' END AS cause_group FROM sp"))
def cause_group(spark, sf):
    return spatial(spark, sf).select("id", C.cause_group("cause").alias("cause_group"))


# ------------------------------------------------------------------- filters
@query("bbox_filter", on_incidents(
    "SELECT id, latitude, longitude FROM incidents WHERE latitude BETWEEN 12.80 AND 13.27 AND longitude BETWEEN 77.31 AND 77.77"))
def bbox_filter(spark, sf):
    return cleaning.bbox_filter(incidents(spark, sf)).select("id", "latitude", "longitude")


@query("usable_duration", on_features(
    "SELECT id, round(duration_h, 6) AS duration_h FROM ft WHERE duration_h BETWEEN 0 AND 720"))
def usable_duration(spark, sf):
    return cleaning.usable_durations(features(spark, sf)).select("id", F.round("duration_h", 6).alias("duration_h"))


@query("drop_null_start", on_incidents("SELECT id, start_datetime FROM incidents WHERE start_datetime IS NOT NULL"))
def drop_null_start(spark, sf):
    return incidents(spark, sf).dropna(subset=["start_datetime"]).select("id", "start_datetime")


@query("baseline_split", on_incidents(
    "SELECT id, CASE WHEN start_datetime < (SELECT min(start_datetime) FROM incidents) + INTERVAL 20 DAY "
    "THEN 'baseline' ELSE 'live' END AS part FROM incidents WHERE start_datetime IS NOT NULL"))
def baseline_split(spark, sf):
    from roadwatch.operators.anomaly import split_baseline
    return split_baseline(incidents(spark, sf), days=20).select("id", "part")


@query("peak_slice", on_spatial(
    "SELECT id, CASE WHEN time_band IN ('early_morning','evening') THEN 'peak' ELSE 'offpeak' END AS time_slice FROM sp"))
def peak_slice(spark, sf):
    from roadwatch.operators.clusters import with_time_slice
    return with_time_slice(spatial(spark, sf)).select("id", "time_slice")


@query("validate_columns", on_incidents(
    "SELECT 'junction' AS missing, count(*) AS n_rows FROM incidents UNION ALL SELECT 'zone', count(*) FROM incidents"))
def validate_columns(spark, sf):
    thin = incidents(spark, sf).drop("zone", "junction")
    names = sorted(missing_columns(thin))
    full = conform(thin)
    marks = F.explode(F.array(*[F.struct(F.lit(n).alias("missing"), F.col(n).isNull().alias("empty")) for n in names]))
    return (full.select(marks.alias("m")).groupBy(F.col("m.missing").alias("missing"))
            .agg(F.count_if("m.empty").alias("n_rows")))


@query("scan_incidents", on_incidents(
    "SELECT id, event_cause, corridor, priority, requires_road_closure, start_datetime, latitude, longitude FROM incidents"))
def scan(spark, sf):
    """Round trip through the published CSV layout, read back with the explicit schema."""
    from roadwatch.session import new_folder
    cols = ["id", "event_cause", "corridor", "priority", "requires_road_closure", "start_datetime", "latitude", "longitude"]
    path = new_folder(spark, "incident-csv")
    stamp = F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS+00")
    (conform(incidents(spark, sf).withColumn("start_datetime", stamp))
     .write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = scan_incidents(spark, path, "csv")
    return back.select(
        F.col("id").cast("long").alias("id"), "event_cause", "corridor", "priority",
        F.col("requires_road_closure").cast("boolean").alias("requires_road_closure"),
        C.parse_timestamp("start_datetime").alias("start_datetime"), "latitude", "longitude").select(*cols)


# ------------------------------------------------------------------ counting
@query("count_by_hour", on_spatial("SELECT hour, count(*) AS n FROM sp GROUP BY hour"))
def count_by_hour(spark, sf):
    return spatial(spark, sf).groupBy("hour").agg(F.count("*").alias("n"))


@query("count_by_dow", on_spatial("SELECT dow, count(*) AS n FROM sp GROUP BY dow"))
def count_by_dow(spark, sf):
    return spatial(spark, sf).groupBy("dow").agg(F.count("*").alias("n"))


@query("top_causes", on_spatial("SELECT cause, count(*) AS n FROM sp GROUP BY cause ORDER BY n DESC, cause LIMIT 6"))
def top_causes(spark, sf, n=S.N_DENSITY_CAUSES):
    from roadwatch.operators.stats import top_causes as op
    return op(spatial(spark, sf), n)


@query("band_profile", on_spatial(
    "SELECT time_band, count(*) AS n, round(avg(closure), 3) AS closure_rate, round(avg(impact_score), 3) AS mean_impact "
    "FROM sp GROUP BY time_band"))
def band_profile(spark, sf):
    return spatial(spark, sf).groupBy("time_band").agg(
        F.count("*").alias("n"), F.round(F.avg("closure"), 3).alias("closure_rate"),
        F.round(F.avg("impact_score"), 3).alias("mean_impact"))


@query("overall_baseline", on_spatial(
    "SELECT count(*) AS n, round(avg(closure), 4) AS closure_rate, "
    "round(avg(CASE WHEN corridor = 'non-corridor' THEN 1 ELSE 0 END), 4) AS non_corridor_share FROM sp"))
def overall_baseline(spark, sf):
    from roadwatch.operators.stats import overall_baseline as op
    return op(spatial(spark, sf))


@query("end_coord_share", on_spatial(
    "SELECT count(*) FILTER (WHERE has_end_coord) AS n, round(avg(CAST(has_end_coord AS INTEGER)), 6) AS share FROM sp"))
def end_coord_share(spark, sf):
    return spatial(spark, sf).agg(
        F.count_if("has_end_coord").alias("n"), F.round(F.avg(F.col("has_end_coord").cast("int")), 6).alias("share"))


@query("leak_audit", on_incidents(
    "SELECT round(avg(c) FILTER (WHERE h), 6) AS closure_rate_with_end, round(avg(c) FILTER (WHERE NOT h), 6) AS closure_rate_without_end, "
    "round(count(*) FILTER (WHERE h AND c = 1) / greatest(count(*) FILTER (WHERE c = 1), 1)::DOUBLE, 6) AS end_share_closure, "
    "round(count(*) FILTER (WHERE h AND c = 0) / greatest(count(*) FILTER (WHERE c = 0), 1)::DOUBLE, 6) AS end_share_open, "
    "abs(avg(c) FILTER (WHERE h) - avg(c) FILTER (WHERE NOT h)) > 0.3 AS leak FROM (SELECT CAST(requires_road_closure AS INTEGER) AS c, "
    "(nullif(endlatitude, 0.0) IS NOT NULL AND nullif(endlongitude, 0.0) IS NOT NULL) AS h FROM incidents)"))
def leak_audit(spark, sf):
    from roadwatch.operators.stats import leak_audit as op
    return op(incidents(spark, sf))


@query("determinism_check", on_features(
    "SELECT (SELECT count(*) FROM a WHERE d = 1) AS constant_corridors, (SELECT count(*) FROM a) AS corridors, "
    "(SELECT count(*) FROM b WHERE d > 1) AS mixed_pairs, (SELECT count(*) FROM b) AS pairs, "
    "(SELECT count(*) FILTER (WHERE d = 1) / count(*)::DOUBLE > 0.7 FROM a) AS deterministic").replace(
        " SELECT (SELECT count(*) FROM a WHERE",
        ", a AS (SELECT corridor_cat, count(DISTINCT high) AS d FROM ft GROUP BY 1), "
        "b AS (SELECT corridor_cat, cause_cat, count(DISTINCT high) AS d FROM ft GROUP BY 1, 2) "
        "SELECT (SELECT count(*) FROM a WHERE", 1))
def determinism_check(spark, sf):
    from roadwatch.operators.stats import determinism_check as op
    return op(features(spark, sf))


@query("duration_hours", on_features("SELECT id, round(duration_h, 6) AS duration_h FROM ft"))
def duration_hours(spark, sf):
    return features(spark, sf).select("id", F.round("duration_h", 6).alias("duration_h"))


@query("cause_medians", on_features(
    "SELECT cause_cat, round(median(duration_h), 6) AS median_h, count(*) AS n_examples, count(*) < 30 AS is_fallback "
    "FROM ft WHERE duration_h BETWEEN 0 AND 720 GROUP BY cause_cat"))
def cause_medians(spark, sf):
    from roadwatch.operators.stats import cause_medians as op
    return op(features(spark, sf))


@query("global_median_duration", on_features(
    "SELECT round(median(duration_h), 6) AS median_h FROM ft WHERE duration_h BETWEEN 0 AND 720"))
def global_median_duration(spark, sf):
    from roadwatch.operators.stats import duration_quantiles
    return duration_quantiles(features(spark, sf), {"median_h": 0.5})


@query("log_duration_p95", on_features(
    "SELECT round(quantile_cont(ln(1 + duration_h), 0.95), 6) AS log_p95 FROM ft WHERE duration_h BETWEEN 0 AND 720"))
def log_duration_p95(spark, sf):
    from roadwatch.operators.stats import log_duration_p95 as op
    return op(features(spark, sf))


@query("category_cardinality", on_features(
    "SELECT count(DISTINCT cause_cat) AS cause_cat, count(DISTINCT corridor_cat) AS corridor_cat, count(DISTINCT zone_cat) AS zone_cat, "
    "count(DISTINCT veh_type_cat) AS veh_type_cat, count(DISTINCT police_station_cat) AS police_station_cat FROM ft"))
def category_cardinality(spark, sf):
    return features(spark, sf).agg(*[F.count_distinct(c).alias(c) for c in S.CATEGORICAL_FEATURES])


@query("positive_rates", on_features(
    "SELECT round(avg(closure), 6) AS closure_rate, round(avg(high), 6) AS high_rate FROM ft"))
def positive_rates(spark, sf):
    return features(spark, sf).agg(
        F.round(F.avg("closure"), 6).alias("closure_rate"), F.round(F.avg("high"), 6).alias("high_rate"))


@query("column_fill_rates", on_incidents(
    "SELECT col AS column_name, round(r, 6) AS fill_rate FROM (SELECT " + ", ".join(
        f"count({c}) / count(*)::DOUBLE AS {c}" for c in
        ["zone", "junction", "corridor", "veh_type", "endlatitude", "closed_datetime", "assigned_to_police_id", "route_path"])
    + " FROM incidents) UNPIVOT (r FOR col IN (zone, junction, corridor, veh_type, endlatitude, closed_datetime, "
      "assigned_to_police_id, route_path))"))
def column_fill_rates(spark, sf):
    from roadwatch.operators.stats import fill_rates
    return fill_rates(incidents(spark, sf), [
        "zone", "junction", "corridor", "veh_type", "endlatitude", "closed_datetime", "assigned_to_police_id", "route_path"])


@query("target_encode_fit", on_features(
    "SELECT corridor_cat, n, round(prior + (mean - prior) / (1 + exp(-(n - 20) / 20.0::DOUBLE)), 6) AS encoding FROM "
    "(SELECT corridor_cat, count(*) AS n, avg(closure) AS mean FROM ft GROUP BY 1), (SELECT avg(closure) AS prior FROM ft)"))
def target_encode_fit(spark, sf):
    from roadwatch.operators.encoding import fit_target_encoding
    enc = fit_target_encoding(features(spark, sf), "corridor_cat", "closure")
    return enc.select("corridor_cat", "n", F.round("encoding", 6).alias("encoding"))


@query("apply_encoding", on_features(
    "SELECT ft.id, round(coalesce(e.enc, p.prior), 6) AS corridor_te FROM ft LEFT JOIN (SELECT corridor_cat, "
    "(SELECT avg(closure) FROM ft) + (avg(closure) - (SELECT avg(closure) FROM ft)) / (1 + exp(-(count(*) - 20) / 20.0::DOUBLE)) AS enc "
    "FROM ft WHERE id % 2 = 0 AND corridor_cat <> 'road 7' GROUP BY 1) e USING (corridor_cat), (SELECT avg(closure) AS prior FROM ft) p"))
def apply_encoding(spark, sf):
    from roadwatch.operators.encoding import apply_target_encoding, fit_target_encoding
    ft = features(spark, sf)
    known = ft.filter((F.col("id") % 2 == 0) & (F.col("corridor_cat") != "road 7"))
    prior = ft.agg(F.avg("closure")).scalar()
    enc = fit_target_encoding(known, "corridor_cat", "closure", prior=prior)
    out = apply_target_encoding(ft, enc, "corridor_cat", prior, "corridor_te")
    return out.select("id", F.round("corridor_te", 6).alias("corridor_te"))


# ------------------------------------------------------------ scalar families
@query("math_functions", on_features(
    "SELECT id, round(ln(1 + duration_h), 6) AS log1p_h, round(exp(ln(1 + duration_h)) - 1, 4) AS back_h, "
    "CAST(ceil(duration_h) AS BIGINT) AS ceil_h, round_even(duration_h * 2, 0) / 2 AS half_even, "
    "least(greatest(duration_h, 1), 10) AS clipped, round(radians(lat), 9) AS lat_rad FROM ft WHERE duration_h BETWEEN 0 AND 720"))
def math_functions(spark, sf):
    d = F.col("duration_h")
    return cleaning.usable_durations(features(spark, sf)).select(
        "id", F.round(F.log1p(d), 6).alias("log1p_h"), F.round(F.expm1(F.log1p(d)), 4).alias("back_h"),
        F.ceil(d).alias("ceil_h"), (F.bround(d * 2) / 2).alias("half_even"),
        C.clip(d, 1.0, 10.0).alias("clipped"), F.round(F.radians("lat"), 9).alias("lat_rad"))


@query("string_functions", on_incidents(
    "SELECT id, lower(trim(event_cause)) AS tidy, upper(priority) AS upper_priority, "
    "replace(lower(trim(event_cause)), '_', ' ') AS spaced, coalesce(contains(lower(corridor), 'non-corridor'), FALSE) AS off_corridor, "
    "regexp_extract(police_station, '(\\d+)', 1) AS station, printf('%s at %02d:00', status, hour(start_datetime)) AS label FROM incidents"))
def string_functions(spark, sf):
    return incidents(spark, sf).select(
        "id", C.tidy("event_cause").alias("tidy"), F.upper("priority").alias("upper_priority"),
        F.regexp_replace(C.tidy("event_cause"), "_", " ").alias("spaced"),
        F.coalesce(F.lower("corridor").contains("non-corridor"), F.lit(False)).alias("off_corridor"),
        F.regexp_extract("police_station", r"(\d+)", 1).alias("station"),
        F.format_string("%s at %02d:00", "status", F.hour("start_datetime")).alias("label"))


@query("date_functions", on_incidents(
    "SELECT id, CAST(hour(start_datetime) AS INTEGER) AS hour, CAST(isodow(start_datetime) - 1 AS INTEGER) AS dow, "
    "CAST(month(start_datetime) AS INTEGER) AS month, CAST(start_datetime AS DATE) AS day, "
    "CAST(start_datetime AS DATE) + 90 AS cutoff FROM incidents"))
def date_functions(spark, sf):
    return incidents(spark, sf).select(
        "id", F.hour("start_datetime").alias("hour"), F.weekday("start_datetime").alias("dow"),
        F.month("start_datetime").alias("month"), F.to_date("start_datetime").alias("day"),
        F.date_add(F.to_date("start_datetime"), 90).alias("cutoff"))


@query("json_functions", on_incidents(
    "SELECT id, TRY_CAST(json_array_length(CASE WHEN json_valid(route_path) THEN route_path END) AS INTEGER) AS points, "
    "'{\"id\":' || id || ',\"status\":\"' || status || '\"}' AS doc FROM incidents"))
def json_functions(spark, sf):
    parsed = F.from_json("route_path", "array<array<double>>")
    return incidents(spark, sf).select(
        "id", F.when(parsed.isNotNull(), F.size(parsed)).alias("points"), F.to_json(F.struct("id", "status")).alias("doc"))


@query("time_order", on_incidents("SELECT id, start_datetime FROM incidents ORDER BY start_datetime, id"))
def time_order(spark, sf):
    return incidents(spark, sf).select("id", "start_datetime").orderBy("start_datetime", "id")


@query("rolling_baseline", on_incidents(
    ", d AS (SELECT coalesce(corridor, 'Non-corridor') AS corridor, CAST(hour(start_datetime) AS INTEGER) AS hour, "
    "CAST(start_datetime AS DATE) AS day, count(*) AS event_count FROM incidents GROUP BY 1, 2, 3) "
    "SELECT corridor, hour, day, event_count, round(avg(event_count) OVER (PARTITION BY corridor, hour ORDER BY day "
    "RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS rolling_mean FROM d"))
def rolling_baseline(spark, sf):
    from roadwatch.operators.anomaly import daily_counts, rolling_mean
    return rolling_mean(daily_counts(incidents(spark, sf)))
