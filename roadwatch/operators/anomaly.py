"""Corridor-hour baselines, quantile spikes and the isolation forest on counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from roadwatch import settings as S
from roadwatch.functions.columns import portable_hash
from roadwatch.operators.ranking import as_of, count_bucket
from roadwatch.operators.lookup import look_up


# ------------------------------------------------------------------ baselines
def split_baseline(df: DataFrame, days: int = S.BASELINE_DAYS, start: str = "start_datetime") -> DataFrame:
    """Mark rows of the first ``days`` days as 'baseline', the rest as 'live'."""
    df = df.dropna(subset=[start])
    first = df.agg(F.min(start)).scalar()
    cut = first + F.make_dt_interval(F.lit(days))
    return df.withColumn("part", F.when(F.col(start) < cut, "baseline").otherwise("live"))


def _corridor_hour(start: str):
    return [F.coalesce("corridor", F.lit("Non-corridor")).alias("corridor"), F.hour(start).alias("hour")]


def corridor_hour_counts(df: DataFrame, start: str = "start_datetime") -> DataFrame:
    return df.groupBy(*_corridor_hour(start)).agg(F.count("*").alias("event_count"))


def daily_counts(df: DataFrame, start: str = "start_datetime") -> DataFrame:
    return df.groupBy(*_corridor_hour(start), F.to_date(start).alias("day")).agg(F.count("*").alias("event_count"))


def rolling_mean(daily: DataFrame, days: int = S.BASELINE_DAYS) -> DataFrame:
    """Mean of the previous ``days`` daily counts per corridor and hour."""
    day_no = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("corridor", "hour").orderBy(day_no).rangeBetween(-days, -1)
    return daily.withColumn("rolling_mean", F.round(F.avg("event_count").over(w), 6))


# -------------------------------------------------------------- quantile rule
def spike_bounds(baseline: DataFrame, lo: float = 0.025, hi: float = 0.975) -> Column:
    """struct(lo, hi) of baseline counts; state is one entry per distinct count."""
    q = baseline.agg(F.percentile("event_count", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    return q.select(F.struct(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))).scalar()


def quantile_spikes(counts: DataFrame, bounds: Column) -> DataFrame:
    n = F.coalesce("event_count", F.lit(0))
    return counts.withColumn("is_anomaly", (n < bounds["lo"]) | (n > bounds["hi"]))


# ----------------------------------------------------------- isolation forest
def _expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _intervals(values: np.ndarray, rng: np.random.Generator, limit: int):
    """Random one-dimensional isolation tree as (lo, hi, path length) intervals."""
    todo, leaves = [(-np.inf, np.inf, values, 0)], []
    while todo:
        lo, hi, part, depth = todo.pop()
        if depth >= limit or len(part) <= 1 or part.min() == part.max():
            leaves.append((lo, hi, depth + _expected_depth(len(part))))
            continue
        cut = rng.uniform(part.min(), part.max())
        below = part <= cut
        todo.append((lo, cut, part[below], depth + 1))
        todo.append((cut, hi, part[~below], depth + 1))
    return leaves


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = np.sort(pdf["event_count"].to_numpy(dtype=float))
        rng = np.random.default_rng([seed, tree])
        limit = max(1, math.ceil(math.log2(max(len(values), 2))))
        leaves = _intervals(values, rng, limit)
        return pd.DataFrame({
            "tree": tree, "lo": [x[0] for x in leaves], "hi": [x[1] for x in leaves],
            "path_len": [x[2] for x in leaves], "sample_size": len(values),
        })
    return grow


def forest_sample(baseline: DataFrame, trees: int, sample: int, seed: int, key: list[str]) -> DataFrame:
    """``sample`` random baseline rows for each tree, without shuffling rows × trees.

    A hash threshold lets about twice the wanted rows through before the exact cut,
    so only trees × 2 × sample rows are moved whatever the size of the baseline.
    """
    total = baseline.agg(F.count("*")).scalar()
    rows = baseline.select(F.col("event_count").cast("double").alias("event_count"), F.concat_ws("|", *key).alias("_k"))
    drawn = (
        rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_h", portable_hash(F.concat_ws("|", "tree", "_k"), seed))
        .filter(F.col("_h") < F.lit(2.0**32) * (2.0 * sample + 64) / total)
    )
    order = Window.partitionBy("tree").orderBy("_h", "_k")
    return drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample).select("tree", "event_count")


def fit_forest(baseline: DataFrame, trees: int = S.FOREST_TREES, sample: int = S.FOREST_SAMPLE,
               seed: int = S.SEED, key: tuple[str, ...] = ("corridor", "hour")) -> DataFrame:
    """Leaf table (tree, lo, hi, path_len, sample_size): value x is in the leaf with lo < x ≤ hi.

    Each tree sees at most ``sample`` rows, so one group is always small.
    """
    return forest_sample(baseline, trees, sample, seed, list(key)).groupBy("tree").applyInPandas(
        _grow(seed), "tree int, lo double, hi double, path_len double, sample_size int")


def forest_steps(leaves: DataFrame) -> DataFrame:
    """Mean path length over all trees as a step function of the count.

    Leaves are intervals, so their sum over trees is piecewise constant with at most
    trees × 2 × sample steps, a size set by the parameters and not by the data.
    Row (x, mean_path) holds for values above x, up to the next x.
    """
    trees = leaves.agg(F.count_distinct("tree")).scalar()
    ends = F.explode(F.array(
        F.struct(F.col("lo").alias("x"), F.col("path_len").alias("d")),
        F.struct(F.col("hi").alias("x"), (-F.col("path_len")).alias("d"))))
    jumps = (
        leaves.select("sample_size", ends.alias("e")).filter(F.col("e.x") < float("inf"))
        .groupBy(F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"), F.max("sample_size").alias("n"))
    )
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return jumps.select("x", F.struct(
        (F.sum("d").over(upto) / trees).alias("mean_path"), F.max("n").over(upto).alias("sample_size")).alias("step"))


def leaf_range_join(values: DataFrame, leaves: DataFrame) -> DataFrame:
    """Distinct count → mean path length: the interval lookup of each value in the leaves."""
    distinct = values.select(F.col("event_count").cast("double").alias("x")).distinct()
    found = as_of(distinct, forest_steps(leaves), "x", "step", count_bucket("x"))
    return found.select(F.col("x").cast("long").alias("event_count"), "step.mean_path", "step.sample_size")


def isolation_scores(values: DataFrame, leaves: DataFrame) -> DataFrame:
    n = F.col("sample_size").cast("double")
    norm = F.when(n > 2, 2.0 * (F.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n).otherwise(1.0)
    score = -F.pow(F.lit(2.0), -F.col("mean_path") / norm)
    return leaf_range_join(values, leaves).select("event_count", F.round(score, 12).alias("score"))


def forest_offset(baseline: DataFrame, leaves: DataFrame, contamination: float = S.CONTAMINATION) -> Column:
    """Score below which the ``contamination`` share of the baseline falls."""
    scored = baseline.groupBy("event_count").agg(F.count("*").alias("n")).join(isolation_scores(baseline, leaves), "event_count")
    return scored.agg(F.percentile("score", F.lit(contamination), F.col("n"))).scalar()


def forest_detect(counts: DataFrame, leaves: DataFrame, offset: Column) -> DataFrame:
    """Add ``is_anomaly`` and ``confidence`` (0–1) to a table with ``event_count``."""
    counts = counts.withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    decision = F.col("score") - offset
    return (
        look_up(counts, isolation_scores(counts, leaves), ["event_count"])
        .withColumn("is_anomaly", decision < 0)
        .withColumn("confidence", F.round(F.least(F.greatest(0.5 - decision, F.lit(0.0)), F.lit(1.0)), 4))
        .drop("score")
    )


# ------------------------------------------------------------ request batches
def request_problem(corridor: str = "corridor", hour: str = "hour", count: str = "event_count") -> Column:
    """Why a request cannot be scored; null for a valid one. Values that are no numbers count as missing."""
    h, n = F.expr(f"try_cast({hour} AS double)"), F.expr(f"try_cast({count} AS double)")
    return (F.when(F.coalesce(F.trim(F.col(corridor)), F.lit("")) == "", "corridor is missing")
            .when(h.isNull() | (h < 0) | (h > 23) | (h != F.floor(h)), "hour is not a whole number from 0 to 23")
            .when(n.isNull() | (n < 0) | (n != F.floor(n)), "event_count is not a whole number from 0"))


def split_requests(batch: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows with hour and event_count as numbers, refused rows with ``problem``); every row is in exactly one.

    ``seen`` counts both while the batch is read: observe it through either output.
    """
    judged = batch.withColumn("problem", request_problem())
    if seen is not None:
        judged = judged.observe(seen, F.count("*").alias("requests"), F.count("problem").alias("refused"))
    valid = judged.where("problem IS NULL").drop("problem").withColumns(
        {c: F.expr(f"try_cast({c} AS double)").cast(kind) for c, kind in (("hour", "int"), ("event_count", "long"))})
    return valid, judged.where("problem IS NOT NULL")


class ForestTable:
    """The forest as two arrays in order of the count: what a stream needs to score a count inside its query.

    Counts are whole numbers, so steps between two of them are one; the arrays are bounded by trees x 2 x sample.
    """

    def __init__(self, leaves: DataFrame, offset: float):
        steps = forest_steps(leaves).select("x", "step.mean_path", "step.sample_size").orderBy("x").collect()
        last: dict[float, float] = {}
        for x, mean, size in steps:
            norm = 2.0 * (math.log(size - 1.0) + float(np.euler_gamma)) - 2.0 * (size - 1.0) / size if size > 2 else 1.0
            last[max(float(math.floor(x)), -1.0) if math.isfinite(x) else -1.0] = round(-(2.0 ** (-mean / norm)), 12)
        self.limits, self.scores, self.offset = list(last), list(last.values()), offset

    def score(self, count: Column) -> Column:
        """Score of the last step below the count, found by halving."""
        limits, scores = F.array(*map(F.lit, self.limits)), F.array(*map(F.lit, self.scores))
        bits = max(1, len(self.limits)).bit_length()
        halves = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
        below = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(limits, at + half - 1) < count, at + half).otherwise(at))
        return F.get(scores, below - 1)

    def flag(self, counts: DataFrame) -> DataFrame:
        """Add ``is_anomaly`` and ``confidence`` as the batch does; no join and no state, so a stream may use it."""
        n = F.coalesce("event_count", F.lit(0))
        decision = self.score(n.cast("double")) - F.lit(self.offset)
        return counts.withColumn("event_count", n).withColumn("is_anomaly", decision < 0).withColumn(
            "confidence", F.round(F.least(F.greatest(0.5 - decision, F.lit(0.0)), F.lit(1.0)), 4))


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total_points"), F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(~F.col("is_anomaly")).alias("normal_count"),
        F.round(F.avg(F.col("is_anomaly").cast("int")), 6).alias("anomaly_rate"))


# --------------------------------------------------------------- comparisons
def predicted_vs_actual(df: DataFrame, actual_duration: Column | None = None) -> DataFrame:
    """Replay rule: breakdowns are predicted High, the closure flag predicts itself, 2 hours. ``actual_duration`` is
    added where it is known."""
    closed = F.coalesce(F.col("requires_road_closure"), F.lit(False))
    return df.select(
        F.col("id").alias("incident_id"),
        F.when(F.col("event_cause") == "vehicle_breakdown", "High").otherwise("Low").alias("predicted_priority"),
        closed.alias("predicted_closure"), F.lit(2.0).alias("predicted_duration"),
        F.coalesce("priority", F.lit("Low")).alias("actual_priority"), closed.alias("actual_closure"),
        *([] if actual_duration is None else [actual_duration.alias("actual_duration")]))


def accuracy_metrics(log: DataFrame) -> DataFrame:
    """Share of right closure and priority predictions; mean absolute duration error where known."""
    return log.agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("predicted_closure") == F.col("actual_closure")).cast("int")), 6).alias("closure_accuracy"),
        F.round(F.avg((F.col("predicted_priority") == F.col("actual_priority")).cast("int")), 6).alias("priority_accuracy"),
        F.round(F.avg(F.abs(F.col("predicted_duration") - F.col("actual_duration"))), 6).alias("duration_mae"))


def baseline_counts(df: DataFrame, days: int = S.BASELINE_DAYS, per_day: bool = False) -> DataFrame:
    """Corridor-hour counts of the baseline period: period totals, or one row per day with ``per_day``.

    Period totals set against one-day counts is the published behaviour; ``per_day``
    puts both on the same scale.
    """
    base = split_baseline(df, days).filter("part = 'baseline'")
    return daily_counts(base) if per_day else corridor_hour_counts(base)


def live_counts(df: DataFrame, days: int = S.BASELINE_DAYS) -> DataFrame:
    return daily_counts(split_baseline(df, days).filter("part = 'live'"))
