"""Historical cases with a known deployment, and the report against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators.rules import recommend_batch, simulate_impact

ROUTE_TYPE = "array<array<double>>"
EMPTY_ROUTES = ("[]", "", "nan", "None")


def route_points(c="route_path") -> Column:
    """Parsed coordinate list, or null when the text is not a real route."""
    text = F.col(c)
    parsed = F.from_json(text, ROUTE_TYPE)
    real = ~text.isin(*EMPTY_ROUTES) & (F.length(text) > 10) & (F.size(parsed) >= 2)
    return F.when(real, parsed)


def officer_cases(df: DataFrame) -> DataFrame:
    """Rows with an assigned officer, in the 14-field case layout."""
    return df.filter(F.col("assigned_to_police_id").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "event_cause", "corridor", "zone",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("latitude", "longitude", "endlatitude", "endlongitude")],
        "start_datetime", "priority", F.coalesce("requires_road_closure", F.lit(False)).alias("requires_road_closure"),
        "status", "assigned_to_police_id", "police_station")


def route_cases(df: DataFrame) -> DataFrame:
    """Rows with a real route, in the 9-field case layout."""
    return df.withColumn("route_path_coords", route_points()).filter(F.col("route_path_coords").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "event_cause", "corridor",
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"), F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
        "start_datetime", "priority", "route_path_coords", F.size("route_path_coords").alias("route_n_points"))


def anchor_summary(df: DataFrame, top: int = 5) -> DataFrame:
    """Totals, officer and route shares, causes and top corridors of officer cases.

    Two-step aggregation by (cause, corridor): the maps are built from a table of
    category values, never from rows.
    """
    officer = F.col("assigned_to_police_id").isNotNull()
    cells = df.groupBy("event_cause", "corridor").agg(
        F.count("*").alias("n"), F.count_if(officer).alias("officers"),
        F.count_if(route_points().isNotNull()).alias("routes")).persist()

    def counts(column):
        return cells.filter(F.col(column).isNotNull() & (F.col("officers") > 0)).groupBy(column).agg(F.sum("officers").alias("n"))

    def as_text(table, column):
        entry = F.concat(F.col(column), F.lit("="), F.col("n").cast("string"))
        return table.agg(F.array_join(F.array_sort(F.collect_list(entry)), ";")).scalar()

    corridors = counts("corridor").orderBy(F.desc("n"), "corridor").limit(top)
    total = F.sum("n")
    return cells.agg(
        total.alias("total_rows"), F.sum("officers").alias("officer_assigned_count"),
        F.round(F.sum("officers") / total * 100, 2).alias("officer_assigned_pct"),
        F.sum("routes").alias("real_route_count"), F.round(F.sum("routes") / total * 100, 2).alias("real_route_pct"),
    ).select("*", as_text(counts("event_cause"), "event_cause").alias("officer_causes"),
             as_text(corridors, "corridor").alias("officer_top_corridors"))


def anchor_comparison(df: DataFrame, risk: DataFrame, simulate=simulate_impact, recommend=recommend_batch) -> DataFrame:
    """Recommended against known deployment for officer cases.

    ``simulate`` and ``recommend`` are table functions, so either can be replaced.
    """
    cases = officer_cases(df)
    plans = recommend(simulate(cases), risk, None)
    known = cases.select("id", F.col("event_cause").alias("raw_cause"), F.col("corridor").alias("raw_corridor"),
                         "priority", "requires_road_closure", "police_station")
    return plans.join(known, plans.incident_id == known.id).select(
        "incident_id", F.col("raw_cause").alias("cause"), F.col("raw_corridor").alias("corridor"), "priority",
        F.col("requires_road_closure").alias("requires_closure"), F.lit(True).alias("had_real_officer"), "police_station",
        F.col("recommended_officers").alias("engine_recommended_officers"),
        F.col("recommended_barricades").alias("engine_recommended_barricades"),
        F.col("impact_score").alias("engine_impact_score"),
        F.round("closure_probability", 3).alias("engine_closure_prob"),
        F.col("escalate_to").alias("engine_escalations"),
        F.element_at("explanation", -1).alias("explanation_summary"))


def validation_summary(report: DataFrame) -> DataFrame:
    """Distribution of the recommendations; medians are cut to whole numbers.

    The measured columns have at most 31 distinct values, so the median state is tiny.
    """
    o, b, i = (F.col(f"engine_{c}") for c in ("recommended_officers", "recommended_barricades", "impact_score"))

    def whole_median(c):
        return F.floor(F.median(c)).cast("int")

    return report.agg(
        F.count("*").alias("n_cases"), F.round(F.avg(o), 1).alias("officers_mean"), whole_median(o).alias("officers_median"),
        F.min(o).alias("officers_min"), F.max(o).alias("officers_max"),
        F.round(F.avg(b), 1).alias("barricades_mean"), whole_median(b).alias("barricades_median"),
        F.round(F.avg(i), 1).alias("impact_mean"), whole_median(i).alias("impact_median"),
        F.count_if(o >= 5).alias("high_deployment_count"),
        F.count_if(F.col("engine_closure_prob") > 0.5).alias("closure_triggered_count"))


def cause_distribution(report: DataFrame) -> DataFrame:
    return report.groupBy("cause").agg(F.count("*").alias("n"))


def diverse_sample(df: DataFrame, n: int = 1, seed: int = S.SEED, causes=S.SAMPLE_CAUSES) -> DataFrame:
    """n incidents per cause; named corridors, then real end coordinates, when enough of them exist.

    Ranking uses ``row_number() <= n``, which Spark cuts to n rows per task before the shuffle.
    """
    from pyspark.sql import Window

    cause = C.tidy("event_cause")
    named = F.col("corridor").isNotNull() & ~F.lower("corridor").contains("non-corridor")
    ended = F.col("endlatitude").isNotNull() & (F.col("endlatitude") != 0)
    rows = df.withColumns({"_cause": cause, "_named": named, "_ended": ended}).filter(F.col("_cause").isin(*causes))
    pools = rows.groupBy("_cause").agg(
        (F.count_if("_named") >= n).alias("_use_named"),
        (F.count_if(F.col("_named") & F.col("_ended")) >= n).alias("_end_named"),
        (F.count_if("_ended") >= n).alias("_end_any"))
    use_end = F.when(F.col("_use_named"), F.col("_end_named")).otherwise(F.col("_end_any"))
    eligible = (F.col("_named") | ~F.col("_use_named")) & (F.col("_ended") | ~use_end)
    order = Window.partitionBy("_cause").orderBy(C.portable_hash("id", seed), "id")
    return (
        rows.join(F.broadcast(pools), "_cause").filter(eligible)  # one row per listed cause
        .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
        .drop("_named", "_ended", "_use_named", "_end_named", "_end_any", "_rn")
        .withColumnRenamed("_cause", "sample_cause")
    )
