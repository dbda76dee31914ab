"""JSON documents: corridor risk, GeoJSON hotspots, fallback medians, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C

CORRIDOR_FIELDS = (
    "corridor string, event_count bigint, closure_rate double, mean_impact double, "
    "peak_hour int, risk_score double, risk_tier string, dominant_cause string"
)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def corridor_document(published, sp: DataFrame) -> DataFrame:
    """One row: header and ranked corridors (one entry per corridor, a small dimension)."""
    base = sp.agg(F.struct(
        F.round(F.avg("closure"), 4).alias("closure"),
        F.round(F.avg((F.col("corridor") == "non-corridor").cast("int")), 4).alias("off"))).scalar()
    entry = F.struct(*[F.col(c) for c in published.columns])
    ranked = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["risk_score"] > b["risk_score"], -1).when(a["risk_score"] < b["risk_score"], 1)
        .when(a["corridor"] < b["corridor"], -1).when(a["corridor"] > b["corridor"], 1).otherwise(0))
    return published.agg(
        F.count("*").alias("total_corridors_ranked"), ranked.alias("corridors")
    ).select(
        F.current_timestamp().cast("string").alias("generated_at"), "total_corridors_ranked",
        F.lit(S.MIN_CORRIDOR_EVENTS).alias("min_events_threshold"),
        base["closure"].alias("overall_baseline_closure_rate"), base["off"].alias("non_corridor_event_fraction"), "corridors")


def read_corridor_risk(spark: SparkSession, path: str) -> DataFrame:
    """Corridor lookup keyed by tidy name; absent fields get their defaults."""
    doc = spark.read.schema(f"corridors array<struct<{CORRIDOR_FIELDS.replace(' ', ':').replace(',:', ',')}>>").option(
        "multiLine", True).json(path)
    c = doc.select(F.explode("corridors").alias("c")).select("c.*")
    defaults = {"event_count": 0, "closure_rate": 0.0, "mean_impact": 5.0, "peak_hour": 12,
                "risk_score": 0.5, "risk_tier": "MEDIUM", "dominant_cause": "unknown"}
    return c.select(C.tidy("corridor").alias("corridor"),
                    *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()])


def attach_scores(df: DataFrame, scores: DataFrame, missing: float = 5.0) -> DataFrame:
    """Left join of impact scores on id; rows without a score weigh as ``missing``."""
    joined = df.join(scores, "id", "left")
    return joined.withColumn("impact_weight", F.coalesce(F.col("composite_impact_score").cast("double"), F.lit(missing)) / 10)


def fallback_document(ft: DataFrame, closure_threshold: float, min_examples: int = S.FALLBACK_MIN_EXAMPLES) -> DataFrame:
    """One row: medians and counts per cause (a category table), fallback causes and global figures."""
    from roadwatch.operators import stats

    medians = stats.cause_medians(ft, min_examples).persist()
    overall = stats.duration_quantiles(ft, {"m": 0.5}).scalar()
    p95 = stats.log_duration_p95(ft).scalar()
    return medians.agg(
        F.map_from_entries(F.collect_list(F.struct("cause_cat", "median_h"))).alias("cause_medians"),
        F.map_from_entries(F.collect_list(F.struct("cause_cat", "n_examples"))).alias("n_examples"),
        F.sort_array(F.collect_list(F.when(F.col("is_fallback"), F.col("cause_cat")))).alias("fallback_causes"),
    ).select(
        overall.alias("global_median_h"), "cause_medians", "n_examples", "fallback_causes",
        F.lit(min_examples).alias("fallback_min_examples"), p95.alias("duration_log_p95"),
        F.lit(closure_threshold).alias("closure_threshold"))
