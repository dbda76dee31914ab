"""Rule-based impact and deployment plans, one projection per table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C, geo
from roadwatch.operators.lookup import look_up

TEMPLATE_SCHEMA = (
    "template_cause string, base_officers int, recovery_van int, base_barricades int, "
    "escalate_to array<string>, equipment array<string>, notes string, priority_override string"
)


# --------------------------------------------------------------- lookup tables
def response_templates(spark: SparkSession) -> DataFrame:
    """The decision table without its default row."""
    return spark.createDataFrame(list(S.RESPONSE_TEMPLATES), TEMPLATE_SCHEMA)


def all_templates(spark: SparkSession) -> DataFrame:
    return response_templates(spark).unionByName(spark.createDataFrame([S.DEFAULT_TEMPLATE], TEMPLATE_SCHEMA))


def cause_priors(spark: SparkSession) -> DataFrame:
    rows = [(c, S.CLOSURE_RATE_BY_CAUSE[c], S.MEDIAN_HOURS_BY_CAUSE[c]) for c in S.CLOSURE_RATE_BY_CAUSE]
    return spark.createDataFrame(rows, "cause string, closure_rate double, median_h double")


# ------------------------------------------------------------- look-up joins
def attach_corridor_risk(df: DataFrame, risk: DataFrame) -> DataFrame:
    """Left join on the tidy corridor name; a miss is MEDIUM with score 0.5.

    The risk table is an aggregate of unknown size: it is counted, and the feed
    is not shuffled on the corridor while the count allows a broadcast.
    """
    lookup = risk.select(F.col("corridor").alias("_corridor"),
                         F.upper("risk_tier").alias("_tier"), F.col("risk_score").alias("_score"))
    return (
        look_up(df.withColumn("_corridor", C.tidy("corridor")), lookup, ["_corridor"])
        .withColumns({"corridor_risk_tier": F.coalesce("_tier", F.lit("MEDIUM")),
                      "corridor_risk_score": F.coalesce("_score", F.lit(0.5))})
        .drop("_corridor", "_tier", "_score")
    )


def attach_template(df: DataFrame, cause: Column) -> DataFrame:
    """Template of the tidy cause (15 rows, broadcast); a miss takes the default row."""
    spark = df.sparkSession
    fields = [f.strip().split(" ")[0] for f in TEMPLATE_SCHEMA.split(", ")]
    default = dict(zip(fields, S.DEFAULT_TEMPLATE))
    rules = response_templates(spark).select(C.tidy("template_cause").alias("_key"), F.struct(*fields).alias("_rule"))

    def literal(name):
        value = default[name]
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast("array<string>")
        return F.lit(value).cast("string") if value is None else F.lit(value)

    joined = df.withColumn("_cause", cause).join(F.broadcast(rules), F.col("_cause") == F.col("_key"), "left")
    hit = F.col("_rule").isNotNull()
    return joined.withColumns(
        {name: F.when(hit, F.col(f"_rule.{name}")).otherwise(literal(name)) for name in fields}
    ).drop("_cause", "_key", "_rule")


def attach_priors(df: DataFrame, cause: Column) -> DataFrame:
    """Closure rate and median hours of the tidy cause (14 rows, broadcast)."""
    priors = cause_priors(df.sparkSession).filter("cause <> 'default'").select(
        F.col("cause").alias("_key"), F.col("closure_rate").alias("_rate"), F.col("median_h").alias("_median"))
    return (
        df.withColumn("_cause", cause).join(F.broadcast(priors), F.col("_cause") == F.col("_key"), "left")
        .withColumns({"prior_closure": F.coalesce("_rate", F.lit(S.CLOSURE_RATE_BY_CAUSE["default"])),
                      "prior_hours": F.coalesce("_median", F.lit(S.MEDIAN_HOURS_BY_CAUSE["default"]))})
        .drop("_cause", "_key", "_rate", "_median")
    )


# ------------------------------------------------------------ simulated impact
def simulate_impact(df: DataFrame, compat: bool = False) -> DataFrame:
    """Impact score, probabilities and expected hours from rules alone.

    ``compat`` treats a missing corridor as a named one, as the original text rule does.
    """
    corridor = C.tidy("corridor")
    named = F.coalesce(~corridor.isin("", "non-corridor"), F.lit(compat))
    hour = C.hour_from_text(F.col("start_datetime").cast("string"))
    peak = hour.between(4, 7) | hour.between(19, 23)
    priority = C.tidy("priority")
    p = F.when(priority == "high", S.PRIORITY_PROB["high"]).when(priority == "low", S.PRIORITY_PROB["low"]).otherwise(0.5)
    df = attach_priors(df, C.tidy("event_cause"))
    closure = F.when(C.truth("requires_road_closure", S.TRUTH_RULES) == 1, F.greatest("prior_closure", F.lit(0.85))).otherwise(
        F.col("prior_closure"))
    p50 = F.col("prior_hours") * F.when(named, 1.2).otherwise(1.0) * F.when(peak, 1.15).otherwise(1.0)
    return (
        df.withColumns({"_p": p, "_c": closure, "_p50": p50})
        .withColumns({
            "impact_score": C.composite_score(F.col("_p"), F.col("_c"), F.col("_p50"),
                                              F.lit(math.log1p(S.RULES_DURATION_CAP_H))),
            "closure_probability": F.round("_c", 4),
            "priority_probability": F.round("_p", 4),
            "expected_duration_h": F.round("_p50", 2),
            "expected_duration_p90_h": F.round(F.col("_p50") * 2.0, 2),
        })
        .drop("_p", "_c", "_p50", "prior_closure", "prior_hours")
    )


# --------------------------------------------------------------- plan building
def plan_fields(df: DataFrame) -> DataFrame:
    """Tidy plan columns with their defaults."""
    return df.select(
        "*",
        F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("incident_id"),
        F.coalesce(C.tidy("event_cause"), F.lit("unknown")).alias("cause"),
        C.clean_category("corridor", "non-corridor").alias("plan_corridor"),
        F.coalesce(F.nullif(F.btrim("zone"), F.lit("")), F.lit("unknown")).alias("plan_zone"),
        F.coalesce("latitude", F.lit(0.0)).alias("plan_lat"), F.coalesce("longitude", F.lit(0.0)).alias("plan_lon"),
        C.hour_from_text(F.col("start_datetime").cast("string")).alias("plan_hour"),
    )


def _step(score: Column, step: float, clamp: tuple[float, float]) -> Column:
    return C.clip(1.0 + step * (score - 5), *clamp)


def scale_resources(df: DataFrame) -> DataFrame:
    """Unrounded officers and barricades after each stage; multiplication order is kept."""
    df = df.withColumns({
        "officer_mult": _step(F.col("impact_score"), S.OFFICER_STEP, S.OFFICER_CLAMP),
        "barricade_mult": _step(F.col("impact_score"), S.BARRICADE_STEP, S.BARRICADE_CLAMP),
    })
    return df.withColumns({"scaled_officers": F.col("base_officers") * F.col("officer_mult"),
                           "scaled_barricades": F.col("base_barricades") * F.col("barricade_mult")})


def _tier_value(i: int) -> Column:
    tier = F.col("corridor_risk_tier")
    return (F.when(tier == "HIGH", S.TIER_BOOST["HIGH"][i]).when(tier == "MEDIUM", S.TIER_BOOST["MEDIUM"][i])
            .otherwise(S.TIER_BOOST["LOW"][i]))


def corridor_adjust(df: DataFrame) -> DataFrame:
    df = df.withColumns({"tier_officers": _tier_value(0), "tier_barricades": _tier_value(1)})
    return df.withColumns({
        "scaled_officers": F.col("scaled_officers") * (1.0 + F.col("tier_officers")),
        "scaled_barricades": F.col("scaled_barricades") * (1.0 + F.col("tier_barricades"))})


def time_adjust(df: DataFrame) -> DataFrame:
    boost, name = F.when(F.lit(False), 0.0), F.when(F.lit(False), "")
    for label, lo, hi, pct in S.HOUR_BOOST:
        boost, name = boost.when(F.col("plan_hour").between(lo, hi), pct), name.when(F.col("plan_hour").between(lo, hi), label)
    df = df.withColumns({"hour_boost": boost.otherwise(0.0), "hour_band": name})
    return df.withColumn("scaled_officers", F.col("scaled_officers") * (1.0 + F.col("hour_boost")))


def closure_adjust(df: DataFrame) -> DataFrame:
    hit = F.col("closure_probability") > S.CLOSURE_TRIGGER
    officers, barricades = S.CLOSURE_EXTRA
    boards = F.array(*[F.lit(b) for b in S.DIVERSION_BOARDS])
    lacks = ~F.array_contains("equipment", S.DIVERSION_BOARDS[0])
    return df.withColumns({
        "diversion_triggered": hit,
        "scaled_officers": F.col("scaled_officers") + F.when(hit, float(officers)).otherwise(0.0),
        "scaled_barricades": F.col("scaled_barricades") + F.when(hit, float(barricades)).otherwise(0.0),
        "equipment": F.when(hit & lacks, F.concat("equipment", boards)).otherwise(F.col("equipment")),
    })


def shift_relief(df: DataFrame) -> DataFrame:
    extra = F.when(F.col("expected_duration_h") > 12, 2).when(F.col("expected_duration_h") > 6, 1).otherwise(0)
    return df.withColumn("relief", extra).withColumn("scaled_officers", F.col("scaled_officers") + F.col("relief"))


def finalize_counts(df: DataFrame) -> DataFrame:
    idle = F.col("cause") == "test_demo"

    def final(c, bounds):
        return F.when(idle, 0).otherwise(C.clip(F.ceil(c), *bounds)).cast("int")

    return df.withColumns({
        "recommended_officers": final("scaled_officers", S.OFFICER_RANGE),
        "recommended_barricades": final("scaled_barricades", S.BARRICADE_RANGE),
        "recovery_van_needed": F.col("recovery_van") > 0,
    })


def geometric_detour(df: DataFrame, lat="plan_lat", lon="plan_lon", end_lat="endlatitude", end_lon="endlongitude") -> DataFrame:
    """Add ``diversion_route``: a five-point bypass beside the incident axis.

    Built in projections that each use the previous one, so no sine is worked out twice.
    """
    known = F.lit(True)
    for name in (lat, lon, end_lat, end_lon):
        known = known & (F.coalesce(name, F.lit(0.0)) != 0)
    out = df.withColumn("_known", known)   # unknown places stay null, and null geometry costs nothing
    out = out.withColumns({t: F.when(F.col("_known"), F.col(n)) for t, n in zip(("_a", "_o", "_c", "_d"), (lat, lon, end_lat, end_lon))})
    a, o, c, d = (F.col(n) for n in ("_a", "_o", "_c", "_d"))
    out = out.withColumns({"_axis": geo.bearing_deg(a, o, c, d), "_m": (a + c) / 2, "_n": (o + d) / 2})
    axis = F.col("_axis")
    out = out.withColumn("_side", F.when(axis + 90 >= 360, axis - 270).otherwise(axis + 90))
    stops = [(a, o, axis + 180, S.DETOUR_END_M), (a, o, F.col("_side"), S.DETOUR_SIDE_M),
             (F.col("_m"), F.col("_n"), F.col("_side"), S.DETOUR_MID_M),
             (c, d, F.col("_side"), S.DETOUR_SIDE_M), (c, d, axis, S.DETOUR_END_M)]
    out = out.withColumns({f"_y{i}": geo.offset_lat(y, b, m) for i, (y, x, b, m) in enumerate(stops)})
    out = out.withColumns({f"_x{i}": geo.offset_lon(y, x, b, m, F.col(f"_y{i}")) for i, (y, x, b, m) in enumerate(stops)})
    legs = [geo.haversine_m(F.col(f"_y{i}"), F.col(f"_x{i}"), F.col(f"_y{i + 1}"), F.col(f"_x{i + 1}")) for i in range(4)]
    out = out.withColumns({"_detour": legs[0] + legs[1] + legs[2] + legs[3], "_direct": geo.haversine_m(a, o, c, d)})
    known, detour, direct = F.col("_known"), F.col("_detour"), F.col("_direct")
    coords = F.array(*[F.array(f"_y{i}", f"_x{i}") for i in range(5)])
    route = F.struct(
        F.when(known, "ok").otherwise("no_coordinates").alias("status"),
        F.when(known, "geometric_fallback").otherwise("none").alias("method"),
        F.when(known, coords).otherwise(F.array().cast("array<array<double>>")).alias("route_coords"),
        F.when(known, 5).alias("n_waypoints"),
        F.when(known, F.round(detour / 1000, 2)).alias("detour_distance_km"),
        F.when(known, F.round(direct / 1000, 2)).alias("direct_distance_km"),
        F.when(known, F.round((detour - direct) / 1000, 2)).alias("extra_distance_km"),
        F.when(known, F.round(detour / 1000 / S.DETOUR_SPEED_KMH * 60, 1)).alias("estimated_time_min"),
        F.lit(0).alias("blocked_nodes"), F.lit(0).alias("blocked_edges"),
    )
    temp = [n for n in out.columns if n.startswith("_") and n not in df.columns]
    return out.withColumn("diversion_route", route).drop(*temp)


def attach_diversion(df: DataFrame, detour: Callable[[DataFrame], DataFrame] | None = geometric_detour) -> DataFrame:
    """Route for triggered plans with end coordinates.

    ``detour`` is a table function that adds ``diversion_route``; any router can be put in.
    """
    if detour is None:
        return df.withColumn("diversion_route", F.lit(None).cast("struct<status:string>"))
    wanted = F.col("diversion_triggered") & (F.coalesce("endlatitude", F.lit(0.0)) > 0) & (F.coalesce("endlongitude", F.lit(0.0)) > 0)
    ends = {c: F.when(wanted, F.col(c)) for c in ("endlatitude", "endlongitude")}
    return detour(df.withColumns(ends)).withColumn("diversion_route", F.when(wanted, F.col("diversion_route")))


def explanation_trail(df: DataFrame) -> DataFrame:
    """Ordered reasons for the numbers; stages that did not apply are left out."""
    def say(*parts) -> Column:
        """Join literals and columns (given in a list) to one text."""
        return F.concat(*[F.col(p[0]).cast("string") if isinstance(p, list) else F.lit(p) if isinstance(p, str) else p for p in parts])

    def times(step, clamp) -> Column:
        """The multiplier text of each of the ten scores, looked up instead of formatted per row."""
        texts = [f"{max(clamp[0], min(1.0 + step * (score - 5), clamp[1])):.2f}x" for score in range(1, 11)]
        return F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("impact_score"))

    clock = F.lpad(F.col("plan_hour").cast("string"), 2, "0")
    hours = F.bround("expected_duration_h", 1).cast("decimal(12,1)").cast("string")
    base = F.concat(
        say("Base template: ", ["template_cause"], " -> ", ["base_officers"], " officers, ", ["base_barricades"], " barricades"),
        F.when(F.col("recovery_van") > 0, say(", ", ["recovery_van"], " recovery van")).otherwise(""),
        F.when(F.size("escalate_to") > 0, F.concat(F.lit(", escalate to "), F.array_join("escalate_to", ", "))).otherwise(""))
    impact = say("Impact score ", ["impact_score"], "/10 -> officer multiplier ", times(S.OFFICER_STEP, S.OFFICER_CLAMP),
                 ", barricade multiplier ", times(S.BARRICADE_STEP, S.BARRICADE_CLAMP))
    corridor = F.when(F.col("tier_officers") > 0, say(
        ["corridor_risk_tier"], "-risk corridor (", ["plan_corridor"], ") -> +", C.percent(F.col("tier_officers")),
        " officers, +", C.percent(F.col("tier_barricades")), " barricades")).otherwise(
        say("Corridor risk: ", ["corridor_risk_tier"], " (", ["plan_corridor"], ") -> no adjustment"))
    time = F.when(F.col("hour_band").isNotNull(), say(
        ["hour_band"], " hour (", clock, ":00) -> +", C.percent(F.col("hour_boost")), " officers")).otherwise(
        say("Off-peak hour (", clock, ":00) -> no time adjustment"))
    chance = C.percent(F.col("closure_probability"))
    closure = F.when(F.col("diversion_triggered"), say(
        "Road closure probable (", chance, ") -> +2 officers (diversion management), +4 barricades (closure points), "
        "diversion route triggered")).otherwise(say("Road closure unlikely (", chance, ") -> no closure adjustment"))
    relief = (
        F.when(F.col("relief") == 2, say("Long-duration event (", hours, "h) -> +2 officers for shift relief"))
        .when(F.col("relief") == 1, say("Medium-duration event (", hours, "h) -> +1 officer for shift overlap")))
    final = say("Final recommendation: ", ["recommended_officers"], " officers, ", ["recommended_barricades"], " barricades")
    reasons = [base, impact, corridor, time, closure, relief, final]
    if "diversion_route" in df.columns and "detour_distance_km" in df.schema["diversion_route"].dataType.fieldNames():
        route = F.col("diversion_route")
        reasons.append(
            F.when(route["status"] == "ok", F.concat(
                F.lit("Diversion route computed: "), route["detour_distance_km"].cast("string"), F.lit(" km, ~"),
                route["estimated_time_min"].cast("string"), F.lit(" min")))
            .when(route.isNotNull(), "Diversion route: fallback geometric detour applied"))
    return df.withColumn("explanation", F.filter(F.array(*reasons), lambda r: r.isNotNull()))


def staged_plans(df: DataFrame, risk: DataFrame | None = None, detour: Callable[[DataFrame], DataFrame] | None = geometric_detour) -> DataFrame:
    """All stages over incidents that already carry an impact prediction."""
    if "corridor_risk_tier" not in df.columns:
        if risk is None:
            df = df.withColumns({"corridor_risk_tier": F.lit("MEDIUM"), "corridor_risk_score": F.lit(0.5)})
        else:
            df = attach_corridor_risk(df, risk)
    df = plan_fields(df)
    df = attach_template(df, F.col("cause"))
    for stage in (scale_resources, corridor_adjust, time_adjust, closure_adjust, shift_relief, finalize_counts):
        df = df.transform(stage)
    return explanation_trail(attach_diversion(df, detour))


def recommend_batch(df: DataFrame, risk: DataFrame | None = None,
                    detour: Callable[[DataFrame], DataFrame] | None = geometric_detour) -> DataFrame:
    """Deployment plans for incidents with impact predictions (one row in, one plan out)."""
    return staged_plans(df, risk, detour).select(
        "incident_id", "cause", F.col("plan_corridor").alias("corridor"), F.col("plan_zone").alias("zone"),
        F.struct(F.col("plan_lat").alias("latitude"), F.col("plan_lon").alias("longitude")).alias("location"),
        F.col("start_datetime").cast("string").alias("start_datetime"), "impact_score",
        F.round("closure_probability", 4).alias("closure_probability"),
        F.round("priority_probability", 4).alias("priority_probability"),
        F.round("expected_duration_h", 2).alias("expected_duration_h"),
        "corridor_risk_tier", F.round("corridor_risk_score", 4).alias("corridor_risk_score"),
        "recommended_officers", "recommended_barricades", "recovery_van_needed", "escalate_to", "equipment",
        "diversion_triggered", "diversion_route", F.col("template_cause").alias("template_used"), "notes", "explanation",
    )
