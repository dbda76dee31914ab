"""Impact rules, deployment plans, detours and anchor validation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C, geo
from roadwatch.operators import anchors as A, rules as R
from roadwatch.plans import corridors
from roadwatch.plans.registry import hash_sql, incidents, on_incidents, query

# ---------------------------------------------------------------- comparison SQL


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "CAST([" + ", ".join(_lit(x) for x in v) + "] AS VARCHAR[])"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


_TEMPLATES = ", ".join("(" + ", ".join(_lit(v) for v in (t[0].lower(), *t)) + ")" for t in S.RESPONSE_TEMPLATES)
_PRIORS = ", ".join(f"('{c}', {r}::DOUBLE, {S.MEDIAN_HOURS_BY_CAUSE[c]}::DOUBLE)"
                    for c, r in S.CLOSURE_RATE_BY_CAUSE.items() if c != "default")
_D = S.DEFAULT_TEMPLATE

ALL_CASES = ("SELECT id, event_cause, corridor, zone, latitude, longitude, endlatitude, endlongitude, start_datetime, "
             "priority, requires_road_closure FROM incidents")


def _rules_ctes(cases: str, prefix: str) -> str:
    return prefix + f""", cases AS ({cases}),
tmpl(key, template_cause, base_officers, recovery_van, base_barricades, escalate_to, equipment, notes, priority_override) AS (VALUES {_TEMPLATES}),
prior(cause, rate, med) AS (VALUES {_PRIORS}),
im0 AS (SELECT c.*, lower(trim(event_cause)) AS tc,
 CASE lower(trim(priority)) WHEN 'high' THEN 0.85::DOUBLE WHEN 'low' THEN 0.15::DOUBLE ELSE 0.5::DOUBLE END AS p,
 CASE WHEN requires_road_closure THEN greatest(coalesce(rate, 0.083::DOUBLE), 0.85::DOUBLE) ELSE coalesce(rate, 0.083::DOUBLE) END AS cl,
 coalesce(CAST(hour(start_datetime) AS INTEGER), 12) AS h,
 coalesce(med, 4.0::DOUBLE) * (CASE WHEN nullif(lower(trim(corridor)), '') <> 'non-corridor' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN coalesce(hour(start_datetime), 12) BETWEEN 4 AND 7 OR coalesce(hour(start_datetime), 12) BETWEEN 19 AND 23 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) AS p50
 FROM cases c LEFT JOIN prior ON prior.cause = lower(trim(event_cause))),
im AS (SELECT *, CAST(least(greatest(greatest(round_even(1 + 9 * (0.4::DOUBLE * p + 0.4::DOUBLE * cl + 0.2::DOUBLE * least(greatest(ln(1 + p50) / ln(73.0::DOUBLE), 0), 1)), 0),
 CASE WHEN p50 > 12 THEN 6 WHEN p50 > 6 THEN 4 ELSE 1 END), 1), 10) AS INTEGER) AS impact_score,
 round(cl, 4) AS closure_probability, round(p, 4) AS priority_probability, round(p50, 2) AS expected_duration_h, round(p50 * 2, 2) AS expected_duration_p90_h FROM im0),
s0 AS (SELECT im.*, CAST(im.id AS VARCHAR) AS incident_id, coalesce(tc, 'unknown') AS cause, coalesce(nullif(lower(trim(im.corridor)), ''), 'non-corridor') AS plan_corridor,
 coalesce(nullif(trim(im.zone), ''), 'unknown') AS plan_zone, coalesce(latitude, 0) AS plan_lat, coalesce(longitude, 0) AS plan_lon,
 coalesce(cr.risk_tier, 'MEDIUM') AS corridor_risk_tier, coalesce(cr.risk_score, 0.5) AS corridor_risk_score,
 coalesce(t.template_cause, 'default') AS template_cause, coalesce(t.base_officers, {_D[1]}) AS base_officers, coalesce(t.recovery_van, {_D[2]}) AS recovery_van,
 coalesce(t.base_barricades, {_D[3]}) AS base_barricades, CASE WHEN t.key IS NULL THEN {_lit(_D[4])} ELSE t.escalate_to END AS escalate_to,
 CASE WHEN t.key IS NULL THEN {_lit(_D[5])} ELSE t.equipment END AS equipment0, CASE WHEN t.key IS NULL THEN {_lit(_D[6])} ELSE t.notes END AS notes, t.priority_override
 FROM im LEFT JOIN cr ON cr.corridor = lower(trim(im.corridor)) LEFT JOIN tmpl t ON t.key = tc),
s1 AS (SELECT *, least(greatest(1.0::DOUBLE + 0.15::DOUBLE * (impact_score - 5), 0.4::DOUBLE), 2.0::DOUBLE) AS officer_mult,
 least(greatest(1.0::DOUBLE + 0.1::DOUBLE * (impact_score - 5), 0.5::DOUBLE), 1.8::DOUBLE) AS barricade_mult,
 CASE corridor_risk_tier WHEN 'HIGH' THEN 0.3::DOUBLE WHEN 'MEDIUM' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS to_, CASE corridor_risk_tier WHEN 'HIGH' THEN 0.2::DOUBLE WHEN 'MEDIUM' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS tb_,
 CASE WHEN h BETWEEN 4 AND 7 THEN 0.2::DOUBLE WHEN h BETWEEN 19 AND 23 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS hb, CASE WHEN h BETWEEN 4 AND 7 THEN 'Morning Peak' WHEN h BETWEEN 19 AND 23 THEN 'Evening Peak' END AS band FROM s0),
s2 AS (SELECT *, base_officers * officer_mult AS off4, base_barricades * barricade_mult AS bar4, closure_probability > 0.5 AS diversion_triggered,
 CASE WHEN expected_duration_h > 12 THEN 2 WHEN expected_duration_h > 6 THEN 1 ELSE 0 END AS relief FROM s1),
s3 AS (SELECT *, off4 * (1.0::DOUBLE + to_) AS off5, bar4 * (1.0::DOUBLE + tb_) AS bar5 FROM s2),
s4 AS (SELECT *, off5 * (1.0::DOUBLE + hb) AS off6 FROM s3),
s5 AS (SELECT *, off6 + (CASE WHEN diversion_triggered THEN 2 ELSE 0 END) AS off7, bar5 + (CASE WHEN diversion_triggered THEN 4 ELSE 0 END) AS bar7,
 CASE WHEN diversion_triggered AND NOT list_contains(equipment0, 'road closure boards') THEN equipment0 || ['road closure boards', 'diversion boards'] ELSE equipment0 END AS equipment FROM s4),
pl AS (SELECT *, off7 + relief AS off8, CASE WHEN cause = 'test_demo' THEN 0 ELSE CAST(least(greatest(ceil(off7 + relief), 1), 20) AS INTEGER) END AS recommended_officers,
 CASE WHEN cause = 'test_demo' THEN 0 ELSE CAST(least(greatest(ceil(bar7), 0), 30) AS INTEGER) END AS recommended_barricades, recovery_van > 0 AS recovery_van_needed FROM s5)"""


def rules_sql(select: str, cases: str = ALL_CASES) -> str:
    return _rules_ctes(cases, corridors.RISK_SQL) + " " + select


def _pct(c):
    return f"printf('%d%%', CAST(round_even({c} * 100, 0) AS INTEGER))"


EXPLANATION_SQL = f"""array_to_string(list_filter([
 printf('Base template: %s -> %d officers, %d barricades', template_cause, base_officers, base_barricades)
  || (CASE WHEN recovery_van > 0 THEN printf(', %d recovery van', recovery_van) ELSE '' END)
  || (CASE WHEN len(escalate_to) > 0 THEN ', escalate to ' || array_to_string(escalate_to, ', ') ELSE '' END),
 printf('Impact score %d/10 -> officer multiplier %.2fx, barricade multiplier %.2fx', impact_score, officer_mult, barricade_mult),
 CASE WHEN to_ > 0 THEN corridor_risk_tier || '-risk corridor (' || plan_corridor || ') -> +' || {_pct('to_')} || ' officers, +' || {_pct('tb_')} || ' barricades'
  ELSE 'Corridor risk: ' || corridor_risk_tier || ' (' || plan_corridor || ') -> no adjustment' END,
 CASE WHEN band IS NOT NULL THEN band || printf(' hour (%02d:00) -> +', h) || {_pct('hb')} || ' officers' ELSE printf('Off-peak hour (%02d:00) -> no time adjustment', h) END,
 CASE WHEN diversion_triggered THEN 'Road closure probable (' || {_pct('closure_probability')} || ') -> +2 officers (diversion management), +4 barricades (closure points), diversion route triggered'
  ELSE 'Road closure unlikely (' || {_pct('closure_probability')} || ') -> no closure adjustment' END,
 CASE relief WHEN 2 THEN printf('Long-duration event (%.1fh) -> +2 officers for shift relief', expected_duration_h)
  WHEN 1 THEN printf('Medium-duration event (%.1fh) -> +1 officer for shift overlap', expected_duration_h) END,
 printf('Final recommendation: %d officers, %d barricades', recommended_officers, recommended_barricades)], lambda x: x IS NOT NULL), ' | ')"""


def cases(spark, sf):
    return incidents(spark, sf)


def impact(spark, sf):
    return R.simulate_impact(cases(spark, sf))


def staged(spark, sf, detour=None):
    return R.staged_plans(impact(spark, sf), corridors.risk(spark, sf), detour)


# --------------------------------------------------------------------- impact
IMPACT_COLS = ["impact_score", "closure_probability", "priority_probability", "expected_duration_h", "expected_duration_p90_h"]


@query("simulate_impact", rules_sql(f"SELECT id, {', '.join(IMPACT_COLS)} FROM im"))
def simulate_impact(spark, sf):
    return impact(spark, sf).select("id", *IMPACT_COLS)


@query("composite_score", rules_sql(
    "SELECT id, CAST(least(greatest(greatest(round_even(1 + 9 * (0.4::DOUBLE * p + 0.4::DOUBLE * cl + 0.2::DOUBLE * least(greatest(ln(1 + p50 * 4) / 5.7691::DOUBLE, 0), 1)), 0), "
    "CASE WHEN p50 * 4 > 12 THEN 6 WHEN p50 * 4 > 6 THEN 4 ELSE 1 END), 1), 10) AS INTEGER) AS score FROM im"))
def composite_score(spark, sf):
    """Published score formula on four times the rule durations, so that every floor occurs."""
    df = R.simulate_impact(cases(spark, sf))
    peak = C.hour_from_text(F.col("start_datetime").cast("string"))
    named = F.coalesce(~C.tidy("corridor").isin("", "non-corridor"), F.lit(False))
    df = R.attach_priors(df, C.tidy("event_cause"))
    p50 = (F.col("prior_hours") * F.when(named, 1.2).otherwise(1.0)
           * F.when(peak.between(4, 7) | peak.between(19, 23), 1.15).otherwise(1.0) * 4)
    return df.select("id", C.composite_score(F.col("priority_probability"), F.col("closure_probability"), p50, F.lit(5.7691)).alias("score"))


@query("cause_prior_join", rules_sql(
    "SELECT c.id, coalesce(rate, 0.083::DOUBLE) AS prior_closure, coalesce(med, 4.0::DOUBLE) AS prior_hours FROM cases c "
    "LEFT JOIN prior ON prior.cause = lower(trim(event_cause)) AND prior.cause <> 'accident'"))
def cause_prior_join(spark, sf):
    key = F.nullif(C.tidy("event_cause"), F.lit("accident"))   # one cause left out, to show the default
    return R.attach_priors(cases(spark, sf), key).select("id", "prior_closure", "prior_hours")


@query("template_join", rules_sql(
    "SELECT id, template_cause, base_officers, recovery_van, base_barricades, array_to_string(escalate_to, ', ') AS escalate_to, "
    "array_to_string(equipment0, ', ') AS equipment, notes, priority_override FROM s0",
    ALL_CASES.replace("event_cause", "CASE WHEN id % 9 = 0 THEN 'something else' WHEN id % 9 = 1 THEN 'DEBRIS ' ELSE event_cause END AS event_cause")))
def template_join(spark, sf):
    cause = F.when(F.col("id") % 9 == 0, "something else").when(F.col("id") % 9 == 1, "DEBRIS ").otherwise(F.col("event_cause"))
    out = R.attach_template(cases(spark, sf), C.tidy(cause))
    return out.select("id", "template_cause", "base_officers", "recovery_van", "base_barricades",
                      F.array_join("escalate_to", ", ").alias("escalate_to"), F.array_join("equipment", ", ").alias("equipment"),
                      "notes", "priority_override")


_TEMPLATE_USE = """ SELECT t.template_cause AS cause, t.base_officers, t.recovery_van, t.base_barricades,
 CAST(coalesce(n.n, 0) AS BIGINT) AS incidents FROM {t} t LEFT JOIN (SELECT lower(trim(event_cause)) AS c, count(*) AS n FROM incidents GROUP BY 1) n ON n.c = lower(t.template_cause)"""


@query("response_templates", rules_sql(_TEMPLATE_USE.format(t="tmpl")))
def response_templates(spark, sf):
    """The decision table with the number of incidents each row serves."""
    return _template_use(R.response_templates(spark), spark, sf)


def _template_use(templates, spark, sf):
    used = cases(spark, sf).groupBy(C.tidy("event_cause").alias("_c")).agg(F.count("*").alias("incidents"))
    return (templates.join(used, F.lower("template_cause") == F.col("_c"), "left")
            .select(F.col("template_cause").alias("cause"), "base_officers", "recovery_van", "base_barricades",
                    F.coalesce("incidents", F.lit(0)).alias("incidents")))


@query("all_templates", rules_sql(_TEMPLATE_USE.format(
    t="(SELECT template_cause, base_officers, recovery_van, base_barricades FROM tmpl UNION ALL SELECT 'default', 2, 0, 2)")))
def all_templates(spark, sf):
    return _template_use(R.all_templates(spark), spark, sf)


# ---------------------------------------------------------------------- stages
@query("plan_fields", rules_sql(
    "SELECT incident_id, cause, plan_corridor AS corridor, plan_zone AS zone, plan_lat AS latitude, plan_lon AS longitude, h AS hour FROM s0"))
def plan_fields(spark, sf):
    return R.plan_fields(cases(spark, sf)).select(
        "incident_id", "cause", F.col("plan_corridor").alias("corridor"), F.col("plan_zone").alias("zone"),
        F.col("plan_lat").alias("latitude"), F.col("plan_lon").alias("longitude"), F.col("plan_hour").alias("hour"))


def _upto(spark, sf, stages):
    df = R.attach_corridor_risk(impact(spark, sf), corridors.risk(spark, sf))
    df = R.attach_template(R.plan_fields(df), F.col("cause"))
    for stage in stages:
        df = df.transform(stage)
    return df


_SCALED = ["scaled_officers", "scaled_barricades"]


def _rounded(df, *extra):
    return df.select("incident_id", *extra, *[F.round(c, 6).alias(c) for c in _SCALED])


@query("scale_resources", rules_sql(
    "SELECT incident_id, round(off4, 6) AS scaled_officers, round(bar4, 6) AS scaled_barricades FROM s5"))
def scale_resources(spark, sf):
    return _rounded(_upto(spark, sf, [R.scale_resources]))


@query("corridor_adjust", rules_sql(
    "SELECT incident_id, corridor_risk_tier, round(off5, 6) AS scaled_officers, round(bar5, 6) AS scaled_barricades FROM s5"))
def corridor_adjust(spark, sf):
    return _rounded(_upto(spark, sf, [R.scale_resources, R.corridor_adjust]), "corridor_risk_tier")


@query("time_adjust", rules_sql(
    "SELECT incident_id, band AS hour_band, round(off6, 6) AS scaled_officers, round(bar5, 6) AS scaled_barricades FROM s5"))
def time_adjust(spark, sf):
    return _rounded(_upto(spark, sf, [R.scale_resources, R.corridor_adjust, R.time_adjust]), "hour_band")


@query("closure_adjust", rules_sql(
    "SELECT incident_id, diversion_triggered, array_to_string(equipment, ', ') AS equipment, round(off7, 6) AS scaled_officers, round(bar7, 6) AS scaled_barricades FROM s5"))
def closure_adjust(spark, sf):
    df = _upto(spark, sf, [R.scale_resources, R.corridor_adjust, R.time_adjust, R.closure_adjust])
    return _rounded(df, "diversion_triggered", F.array_join("equipment", ", ").alias("equipment"))


@query("shift_relief", rules_sql(
    "SELECT incident_id, relief, round(off8, 6) AS scaled_officers, round(bar7, 6) AS scaled_barricades FROM pl"))
def shift_relief(spark, sf):
    stages = [R.scale_resources, R.corridor_adjust, R.time_adjust, R.closure_adjust, R.shift_relief]
    return _rounded(_upto(spark, sf, stages), "relief")


@query("finalize_counts", rules_sql("SELECT incident_id, recommended_officers, recommended_barricades, recovery_van_needed FROM pl"))
def finalize_counts(spark, sf):
    return staged(spark, sf).select("incident_id", "recommended_officers", "recommended_barricades", "recovery_van_needed")


@query("explanation_trail", rules_sql(f"SELECT incident_id, {EXPLANATION_SQL} AS explanation FROM pl"))
def explanation_trail(spark, sf):
    return staged(spark, sf).select("incident_id", F.array_join("explanation", " | ").alias("explanation"))


# ----------------------------------------------------------------- geometry SQL
def hav_sql(a, b, c, d):
    x = (f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))")
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({x}), sqrt(1 - {x})))"


def bearing_sql(a, b, c, d):
    t = (f"(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) "
         f"- sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360)")
    return f"(CASE WHEN {t} >= 360 THEN {t} - 360 ELSE {t} END)"


def _offset_sql(lat, lon, brg, m):
    d = f"({m} / 6371000.0::DOUBLE)"
    p2 = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({brg})))"
    lam = (f"degrees(radians({lon}) + atan2(sin(radians({brg})) * sin({d}) * cos(radians({lat})), "
           f"cos({d}) - sin(radians({lat})) * sin({p2})))")
    return f"degrees({p2})", lam


def _points_sql():
    spots = [("a", "o", "ax + 180", 200), ("a", "o", "side", 500), ("(a + c) / 2", "(o + d) / 2", "side", 600),
             ("c", "d", "side", 500), ("c", "d", "ax", 200)]
    return ", ".join(f"{x} AS y{i}, {y} AS x{i}" for i, s in enumerate(spots) for x, y in [_offset_sql(*s)])


DETOUR_SQL = f""", dt0 AS (SELECT id, plan_lat AS a, plan_lon AS o, coalesce(endlatitude, 0) AS c, coalesce(endlongitude, 0) AS d FROM
 (SELECT id, coalesce(latitude, 0) AS plan_lat, coalesce(longitude, 0) AS plan_lon, endlatitude, endlongitude FROM incidents)),
dt1 AS (SELECT *, a <> 0 AND o <> 0 AND c <> 0 AND d <> 0 AS known, {bearing_sql('a', 'o', 'c', 'd')} AS ax FROM dt0),
dt2 AS (SELECT *, CASE WHEN ax + 90 >= 360 THEN ax - 270 ELSE ax + 90 END AS side FROM dt1),
dt3 AS (SELECT *, {_points_sql()} FROM dt2),
dt AS (SELECT id, known, CASE WHEN known THEN {' + '.join(hav_sql(f'y{i}', f'x{i}', f'y{i+1}', f'x{i+1}') for i in range(4))} END AS m,
 CASE WHEN known THEN {hav_sql('a', 'o', 'c', 'd')} END AS direct, y2, x2 FROM dt3)"""


@query("haversine_m", on_incidents(
    f"SELECT id, round({hav_sql('latitude', 'longitude', 'endlatitude', 'endlongitude')}, 4) AS metres FROM incidents WHERE endlatitude > 0 AND latitude > 0"))
def haversine_m(spark, sf):
    rows = incidents(spark, sf).filter("endlatitude > 0 AND latitude > 0")
    ends = [F.col(c) for c in ("latitude", "longitude", "endlatitude", "endlongitude")]
    return rows.select("id", F.round(geo.haversine_m(*ends), 4).alias("metres"))


@query("bearing_deg", on_incidents(
    f"SELECT id, round({bearing_sql('latitude', 'longitude', 'endlatitude', 'endlongitude')}, 6) AS bearing FROM incidents WHERE endlatitude > 0 AND latitude > 0"))
def bearing_deg(spark, sf):
    rows = incidents(spark, sf).filter("endlatitude > 0 AND latitude > 0")
    ends = [F.col(c) for c in ("latitude", "longitude", "endlatitude", "endlongitude")]
    return rows.select("id", F.round(geo.bearing_deg(*ends), 6).alias("bearing"))


_OFF = _offset_sql("latitude", "longitude", "(id % 360)", "500")


@query("offset_point", on_incidents(f"SELECT id, round({_OFF[0]}, 8) AS lat, round({_OFF[1]}, 8) AS lon FROM incidents"))
def offset_point(spark, sf):
    p = geo.offset_point(F.col("latitude"), F.col("longitude"), (F.col("id") % 360).cast("double"), 500.0)
    return incidents(spark, sf).select("id", F.round(p["lat"], 8).alias("lat"), F.round(p["lon"], 8).alias("lon"))


def _detours(spark, sf, known_only=False):
    rows = incidents(spark, sf)
    if known_only:
        rows = rows.filter("latitude <> 0 AND longitude <> 0 AND endlatitude <> 0 AND endlongitude <> 0")
    return R.geometric_detour(rows, "latitude", "longitude").select("id", F.col("diversion_route").alias("r"))


@query("geometric_detour", on_incidents(
    "SELECT id, CASE WHEN known THEN 'ok' ELSE 'no_coordinates' END AS status, CASE WHEN known THEN 'geometric_fallback' ELSE 'none' END AS method, "
    "CASE WHEN known THEN 5 END AS n_waypoints, round(m / 1000, 2) AS detour_distance_km, round(direct / 1000, 2) AS direct_distance_km, "
    "round((m - direct) / 1000, 2) AS extra_distance_km, round(m / 1000 / 25 * 60, 1) AS estimated_time_min, "
    "CASE WHEN known THEN round(y2, 6) END AS mid_lat, CASE WHEN known THEN round(x2, 6) END AS mid_lon FROM dt").replace(
        " SELECT id, CASE WHEN known", DETOUR_SQL + " SELECT id, CASE WHEN known", 1))
def geometric_detour(spark, sf):
    mid = F.try_element_at("r.route_coords", F.lit(3))
    return _detours(spark, sf).select(
        "id", "r.status", "r.method", "r.n_waypoints", "r.detour_distance_km", "r.direct_distance_km", "r.extra_distance_km",
        "r.estimated_time_min", F.round(mid[0], 6).alias("mid_lat"), F.round(mid[1], 6).alias("mid_lon"))


@query("route_length", on_incidents(DETOUR_SQL + " SELECT id, round(m, 3) AS metres FROM dt WHERE known").replace(") , dt0", "), dt0"))
def route_length(spark, sf):
    points = F.transform("r.route_coords", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))
    return _detours(spark, sf, known_only=True).select("id", F.round(geo.path_length_m(points), 3).alias("metres"))


# ------------------------------------------------------------------ full plans
PLAN_SQL = ("incident_id, cause, plan_corridor AS corridor, plan_zone AS zone, impact_score, closure_probability, priority_probability, "
            "expected_duration_h, corridor_risk_tier, corridor_risk_score, recommended_officers, recommended_barricades, recovery_van_needed, "
            "array_to_string(escalate_to, ', ') AS escalate_to, array_to_string(equipment, ', ') AS equipment, diversion_triggered, template_cause AS template_used")

def plan_columns():
    return ["incident_id", "cause", "corridor", "zone", "impact_score", "closure_probability", "priority_probability",
            "expected_duration_h", "corridor_risk_tier", "corridor_risk_score", "recommended_officers", "recommended_barricades",
            "recovery_van_needed", F.array_join("escalate_to", ", ").alias("escalate_to"),
            F.array_join("equipment", ", ").alias("equipment"), "diversion_triggered", "template_used"]


@query("recommend_batch", rules_sql(
    f"SELECT {PLAN_SQL}, CASE WHEN diversion_triggered AND endlatitude > 0 AND endlongitude > 0 THEN (CASE WHEN known THEN 'ok' ELSE 'no_coordinates' END) END AS route_status, "
    "CASE WHEN diversion_triggered AND endlatitude > 0 AND endlongitude > 0 THEN round(m / 1000, 2) END AS detour_distance_km FROM pl JOIN dt USING (id)").replace(
        " SELECT incident_id", DETOUR_SQL + " SELECT incident_id", 1))
def recommend_batch(spark, sf):
    plans = R.recommend_batch(impact(spark, sf), corridors.risk(spark, sf))
    return plans.select(*plan_columns(), F.col("diversion_route.status").alias("route_status"),
                        F.col("diversion_route.detour_distance_km").alias("detour_distance_km"))


EDGES = " UNION ALL ".join([
    "SELECT CAST(id AS VARCHAR) || '-unknown' AS id, 'Unlisted Cause' AS event_cause, corridor, zone, latitude, longitude, endlatitude, endlongitude, start_datetime, priority, requires_road_closure FROM incidents",
    "SELECT CAST(id AS VARCHAR) || '-missing', '', '', NULL, 0.0, 0.0, NULL, NULL, NULL, '', FALSE FROM incidents",
    "SELECT CAST(id AS VARCHAR) || '-severe', 'accident', corridor, zone, latitude, longitude, endlatitude, endlongitude, start_datetime, 'High', TRUE FROM incidents",
    "SELECT CAST(id AS VARCHAR) || '-demo', 'test_demo', corridor, zone, latitude, longitude, endlatitude, endlongitude, start_datetime, 'Low', FALSE FROM incidents",
])


@query("edge_case_plans", rules_sql("SELECT incident_id, cause, impact_score, recommended_officers, recommended_barricades, template_cause AS template_used FROM pl", EDGES))
def edge_case_plans(spark, sf):
    """Every incident as an unknown cause, with everything missing, at its worst, and as a demo."""
    edge = F.explode(F.array(*[F.lit(e) for e in ("unknown", "missing", "severe", "demo")]))
    df = incidents(spark, sf).withColumn("edge", edge)
    e, none = F.col("edge"), F.lit(None)

    def pick(column, **by):
        out = F.col(column)
        for name, value in by.items():
            out = F.when(e == name, value if not isinstance(value, (str, bool, float)) else F.lit(value)).otherwise(out)
        return out

    df = df.withColumns({
        "id": F.concat_ws("-", F.col("id").cast("string"), "edge"),
        "event_cause": pick("event_cause", unknown="Unlisted Cause", missing="", severe="accident", demo="test_demo"),
        "corridor": pick("corridor", missing=""), "zone": pick("zone", missing=none),
        "latitude": pick("latitude", missing=0.0), "longitude": pick("longitude", missing=0.0),
        "endlatitude": pick("endlatitude", missing=none), "endlongitude": pick("endlongitude", missing=none),
        "start_datetime": pick("start_datetime", missing=none),
        "priority": pick("priority", missing="", severe="High", demo="Low"),
        "requires_road_closure": pick("requires_road_closure", missing=False, severe=True, demo=False),
    })
    plans = R.recommend_batch(R.simulate_impact(df), corridors.risk(spark, sf))
    return plans.select("incident_id", "cause", "impact_score", "recommended_officers", "recommended_barricades", "template_used")


@query("gauge_metrics", rules_sql(
    "SELECT id, impact_score * 10 AS impact, round(closure_probability * 100, 6) AS closure, round(priority_probability * 100, 6) AS priority, "
    "round(least(expected_duration_h * 5, 100), 6) AS duration, round(least(expected_duration_p90_h * 3, 100), 6) AS p90_duration, "
    "CASE WHEN impact_score >= 7 THEN 'high' WHEN impact_score >= 4 THEN 'medium' ELSE 'low' END AS class FROM im"))
def gauge_metrics(spark, sf):
    score = F.col("impact_score")
    return impact(spark, sf).select(
        "id", (score * 10).alias("impact"), F.round(F.col("closure_probability") * 100, 6).alias("closure"),
        F.round(F.col("priority_probability") * 100, 6).alias("priority"),
        F.round(F.least(F.col("expected_duration_h") * 5, F.lit(100.0)), 6).alias("duration"),
        F.round(F.least(F.col("expected_duration_p90_h") * 3, F.lit(100.0)), 6).alias("p90_duration"),
        C.labelled(score, [(4, "low"), (7, "medium")], "high").alias("class"))


@query("display_scale", corridors.RISK_SQL + " SELECT corridor, round(closure_rate * 100, 4) AS closure_pct, round(risk_score * 100, 2) AS risk_pct, "
       "replace(replace(dominant_cause || '_te', '_', ' '), ' te', '') AS label FROM cr")
def display_scale(spark, sf):
    label = F.replace(F.replace(F.concat("dominant_cause", F.lit("_te")), F.lit("_"), F.lit(" ")), F.lit(" te"), F.lit(""))
    return corridors.risk(spark, sf).select(
        "corridor", F.round(F.col("closure_rate") * 100, 4).alias("closure_pct"),
        F.round(F.col("risk_score") * 100, 2).alias("risk_pct"), label.alias("label"))


@query("array_functions", rules_sql(
    "SELECT incident_id, len(equipment) AS n, array_to_string(list_slice(equipment, 1, 2), '+') AS first_two, list_contains(equipment, 'diversion boards') AS has_boards FROM pl"))
def array_functions(spark, sf):
    return staged(spark, sf).select(
        "incident_id", F.size("equipment").alias("n"), F.array_join(F.slice("equipment", 1, 2), "+").alias("first_two"),
        F.array_contains("equipment", "diversion boards").alias("has_boards"))


_MAP = "MAP {" + ", ".join(f"'{c}': {v}::DOUBLE" for c, v in S.MEDIAN_HOURS_BY_CAUSE.items()) + "}"


@query("map_functions", on_incidents(
    f"SELECT id, coalesce({_MAP}[replace(lower(trim(event_cause)), 'accident', 'x')], 4.0::DOUBLE) AS hours FROM incidents"))
def map_functions(spark, sf):
    hours = F.create_map(*[F.lit(x) for pair in S.MEDIAN_HOURS_BY_CAUSE.items() for x in pair])
    key = F.regexp_replace(C.tidy("event_cause"), "accident", "x")
    return incidents(spark, sf).select("id", F.coalesce(F.try_element_at(hours, key), F.lit(4.0)).alias("hours"))


# ---------------------------------------------------------------------- anchors
OFFICERS = "FROM incidents WHERE assigned_to_police_id IS NOT NULL"
_ROUTE_OK = ("route_path IS NOT NULL AND route_path NOT IN ('[]', '', 'nan', 'None') AND length(route_path) > 10 "
             "AND json_valid(route_path) AND json_array_length(CASE WHEN json_valid(route_path) THEN route_path END) >= 2")


@query("anchor_filter", on_incidents(
    f"SELECT id, 'officer' AS kind {OFFICERS} UNION ALL SELECT id, 'route' FROM incidents WHERE {_ROUTE_OK}"))
def anchor_filter(spark, sf):
    inc = incidents(spark, sf)
    officer, route = F.col("assigned_to_police_id").isNotNull(), A.route_points().isNotNull()
    kinds = F.array_compact(F.array(F.when(officer, F.lit("officer")), F.when(route, F.lit("route"))))
    return inc.select("id", F.explode(kinds).alias("kind"))


@query("anchor_project", on_incidents(
    f"SELECT CAST(id AS VARCHAR) AS id, event_cause, corridor, latitude, longitude, start_datetime, priority, CAST(json_array_length(route_path) AS INTEGER) AS route_n_points "
    f"FROM incidents WHERE {_ROUTE_OK}"))
def anchor_project(spark, sf):
    return A.route_cases(incidents(spark, sf)).drop("route_path_coords")


@query("officer_cases", on_incidents(
    "SELECT CAST(id AS VARCHAR) AS id, event_cause, corridor, zone, latitude, longitude, coalesce(endlatitude, 0) AS endlatitude, "
    f"coalesce(endlongitude, 0) AS endlongitude, start_datetime, priority, requires_road_closure, status, assigned_to_police_id, police_station {OFFICERS}"))
def officer_cases(spark, sf):
    return A.officer_cases(incidents(spark, sf))


@query("anchor_summary", on_incidents(
    "SELECT count(*) AS total_rows, count(assigned_to_police_id) AS officer_assigned_count, round(count(assigned_to_police_id) / count(*)::DOUBLE * 100, 2) AS officer_assigned_pct, "
    f"count(*) FILTER (WHERE {_ROUTE_OK}) AS real_route_count, round(count(*) FILTER (WHERE {_ROUTE_OK}) / count(*)::DOUBLE * 100, 2) AS real_route_pct, "
    f"(SELECT string_agg(event_cause || '=' || n, ';' ORDER BY event_cause || '=' || n) FROM (SELECT event_cause, count(*) AS n {OFFICERS} GROUP BY 1)) AS officer_causes, "
    f"(SELECT string_agg(corridor || '=' || n, ';' ORDER BY corridor || '=' || n) FROM (SELECT corridor, count(*) AS n {OFFICERS} AND corridor IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS officer_top_corridors "
    "FROM incidents"))
def anchor_summary(spark, sf):
    return A.anchor_summary(incidents(spark, sf))


@query("officer_causes", on_incidents(f"SELECT event_cause, count(*) AS n {OFFICERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def officer_causes(spark, sf):
    cases_ = incidents(spark, sf).filter(F.col("assigned_to_police_id").isNotNull())
    return cases_.groupBy("event_cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_cause").limit(8)


_OFFICER_CASES = ALL_CASES + " WHERE assigned_to_police_id IS NOT NULL"


@query("anchor_comparison", rules_sql(
    "SELECT incident_id, event_cause AS cause, corridor, priority, requires_road_closure AS requires_closure, TRUE AS had_real_officer, "
    "recommended_officers AS engine_recommended_officers, recommended_barricades AS engine_recommended_barricades, impact_score AS engine_impact_score, "
    "round(closure_probability, 3) AS engine_closure_prob, array_to_string(escalate_to, ', ') AS engine_escalations, "
    "printf('Final recommendation: %d officers, %d barricades', recommended_officers, recommended_barricades) AS explanation_summary FROM pl", _OFFICER_CASES))
def anchor_comparison(spark, sf):
    report = A.anchor_comparison(incidents(spark, sf), corridors.risk(spark, sf))
    return report.withColumn("engine_escalations", F.array_join("engine_escalations", ", ")).drop("police_station")


@query("validation_summary", rules_sql(
    "SELECT count(*) AS n_cases, round(avg(recommended_officers), 1) AS officers_mean, CAST(floor(median(recommended_officers)) AS INTEGER) AS officers_median, "
    "min(recommended_officers) AS officers_min, max(recommended_officers) AS officers_max, round(avg(recommended_barricades), 1) AS barricades_mean, "
    "CAST(floor(median(recommended_barricades)) AS INTEGER) AS barricades_median, round(avg(impact_score), 1) AS impact_mean, "
    "CAST(floor(median(impact_score)) AS INTEGER) AS impact_median, count(*) FILTER (WHERE recommended_officers >= 5) AS high_deployment_count, "
    "count(*) FILTER (WHERE round(closure_probability, 3) > 0.5) AS closure_triggered_count FROM pl", _OFFICER_CASES))
def validation_summary(spark, sf):
    return A.validation_summary(A.anchor_comparison(incidents(spark, sf), corridors.risk(spark, sf)))


@query("validation_causes", rules_sql("SELECT event_cause AS cause, count(*) AS n FROM pl GROUP BY 1", _OFFICER_CASES))
def validation_causes(spark, sf):
    return A.cause_distribution(A.anchor_comparison(incidents(spark, sf), corridors.risk(spark, sf)))


_SAMPLE = "(" + ", ".join(f"'{c}'" for c in S.SAMPLE_CAUSES) + ")"


@query("stratified_sample", on_incidents(
    f", r AS (SELECT id, lower(trim(event_cause)) AS c, corridor IS NOT NULL AND NOT contains(lower(corridor), 'non-corridor') AS named, "
    f"coalesce(endlatitude, 0) <> 0 AS ended, {hash_sql('id', 42)} AS h FROM incidents), "
    "p AS (SELECT c, count(*) FILTER (WHERE named) >= 3 AS un, count(*) FILTER (WHERE named AND ended) >= 3 AS en, count(*) FILTER (WHERE ended) >= 3 AS ea FROM r GROUP BY 1) "
    "SELECT id, c AS sample_cause FROM (SELECT r.*, row_number() OVER (PARTITION BY c ORDER BY h, id) AS rn FROM r JOIN p USING (c) "
    f"WHERE c IN {_SAMPLE} AND (named OR NOT un) AND (ended OR NOT (CASE WHEN un THEN en ELSE ea END))) WHERE rn <= 3").replace(") , r AS", "), r AS"))
def stratified_sample(spark, sf):
    return A.diverse_sample(incidents(spark, sf), n=3).select("id", "sample_cause")


@query("union_samples", on_incidents(
    " SELECT c AS cause, count(*) AS n FROM (SELECT lower(trim(event_cause)) AS c FROM incidents) "
    f"WHERE c IN {_SAMPLE} GROUP BY 1"))
def union_samples(spark, sf):
    tidy = incidents(spark, sf).select("id", C.tidy("event_cause").alias("cause"))
    parts = [tidy.filter(F.col("cause") == cause) for cause in S.SAMPLE_CAUSES]
    return reduce(DataFrame.unionByName, parts).groupBy("cause").agg(F.count("*").alias("n"))
