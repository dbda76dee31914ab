"""Corridor statistics, composite risk and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadwatch import settings as S
from roadwatch.functions import columns as C
from roadwatch.operators.ranking import global_row_number, top_value


def corridor_cube(sp: DataFrame) -> DataFrame:
    """(corridor, cause, hour) totals: the only pass over the incidents.

    Partial aggregation runs before the shuffle, so a corridor with a third of
    all rows still sends at most causes × 24 rows per task.
    """
    return sp.groupBy("corridor", "cause", "hour").agg(
        F.count("*").alias("n"), F.sum("closure").alias("closures"),
        F.sum("is_high_priority").alias("highs"), F.sum("impact_score").alias("impact"),
    )


def corridor_stats(sp: DataFrame) -> DataFrame:
    """One row per corridor from one scan: the cube is placed by corridor once and
    both modes and all totals are taken there. Ties go to the smallest value."""
    cube = corridor_cube(sp).repartition("corridor").withColumns({
        "_by_hour": F.sum("n").over(Window.partitionBy("corridor", "hour")),
        "_by_cause": F.sum("n").over(Window.partitionBy("corridor", "cause")),
    })
    n = F.sum("n")
    return cube.groupBy("corridor").agg(
        n.alias("event_count"), (F.sum("closures") / n).alias("closure_rate"),
        (F.sum("highs") / n).alias("high_priority_rate"), (F.sum("impact") / n).alias("mean_impact"),
        F.sum("impact").alias("total_impact"),
        F.min_by("hour", F.struct(-F.col("_by_hour"), F.col("hour"))).alias("peak_hour"),
        F.min_by("cause", F.struct(-F.col("_by_cause"), F.col("cause"))).alias("dominant_cause"),
    )


def min_events(stats: DataFrame, n: int = S.MIN_CORRIDOR_EVENTS) -> DataFrame:
    return stats.filter(F.col("event_count") >= n)


def minmax_scale(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Scale columns to 0–1 over the table; a constant column gives 0.

    The bounds are a scalar subquery, so no global window gathers the rows.
    """
    bounds = df.agg(F.struct(*[
        f(c).alias(f"{tag}_{c}") for c in columns for tag, f in (("lo", F.min), ("hi", F.max))
    ])).scalar()

    def scaled(c):
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        return F.coalesce((F.col(c) - lo) / F.nullif((hi - lo).cast("double"), F.lit(0.0)), F.lit(0.0))

    return df.withColumns({out: scaled(c) for c, out in columns.items()})


def corridor_risk(sp: DataFrame, n: int = S.MIN_CORRIDOR_EVENTS) -> DataFrame:
    """Composite risk (closure, impact, volume) and tier for corridors with at least n events."""
    w = S.RISK_WEIGHTS
    stats = min_events(corridor_stats(sp), n).persist()  # one row per corridor; spares the bounds a second scan
    scaled = minmax_scale(stats, {
        "closure_rate": "_closure", "mean_impact": "_impact", "event_count": "_volume"})
    score = F.round(w["closure"] * F.col("_closure") + w["impact"] * F.col("_impact") + w["volume"] * F.col("_volume"), 4)
    return (
        scaled.withColumn("risk_score", score).withColumn("risk_tier", C.risk_tier(F.col("risk_score")))
        .drop("_closure", "_impact", "_volume")
    )


def published(risk: DataFrame) -> DataFrame:
    """The columns and roundings of the published corridor table."""
    return risk.select(
        "corridor", "event_count", F.round("closure_rate", 4).alias("closure_rate"),
        F.round("mean_impact", 2).alias("mean_impact"), "peak_hour",
        "risk_score", "risk_tier", "dominant_cause",
    )


def rank_corridors(risk: DataFrame) -> DataFrame:
    """Rank by score (desc), then name. Scores have 4 digits: at most 10,001 buckets."""
    bucket = -F.round(F.col("risk_score") * 10000).cast("long")
    return global_row_number(risk, bucket, [F.desc("risk_score"), "corridor"], name="risk_rank")


def closure_hotlist(sp: DataFrame, n: int = 30) -> DataFrame:
    """Corridors with at least n events against the overall closure rate."""
    totals = sp.groupBy("corridor").agg(F.count("*").alias("event_count"), F.sum("closure").alias("_closures")).persist()
    base = totals.agg(F.sum("_closures") / F.sum("event_count")).scalar()
    rate = F.col("_closures") / F.col("event_count")
    return totals.filter(F.col("event_count") >= n).select(
        "corridor", "event_count", rate.alias("closure_rate"), (rate / F.nullif(base, F.lit(0.0))).alias("lift"))
