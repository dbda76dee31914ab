"""Quality of scores and predictions, from one row per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadwatch.operators.ranking import exact_quantiles, running_totals


def _posneg(label: str) -> dict[str, Column]:
    return {"pos": F.sum(F.col(label)), "neg": F.sum(1 - F.col(label))}


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count half. One row per ``by`` group."""
    t = running_totals(df, score, _posneg(label), by, descending=False)
    below = F.col("cum_neg") - F.col("neg") / 2
    return t.groupBy(*by).agg((F.sum(F.col("pos") * below) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall at each distinct score, highest first."""
    t = running_totals(df, score, _posneg(label)).persist()   # one row per distinct score
    total = t.agg(F.sum("pos")).scalar()
    return t.select(
        score, "pos", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / total).alias("recall"), (F.col("pos") / total).alias("_step"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    return pr_curve(df, score, label).agg(F.sum(F.col("_step") * F.col("precision")).alias("average_precision"))


def threshold_sweep(df: DataFrame, score: str, label: str, lo: float = 0.05, hi: float = 0.95, n: int = 91) -> DataFrame:
    """Precision, recall and F1 at n even thresholds, from a histogram between them."""
    cuts = [round(lo + i * (hi - lo) / (n - 1), 12) for i in range(n)]
    hist = df.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(score) >= c))
    binned = hist.groupBy(passed.alias("passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    total = binned.agg(F.sum("pos")).scalar()
    table = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "passed int, threshold double")
    above = Window.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)   # at most n + 1 rows
    every = table.join(binned, "passed", "left").fillna(0, ["pos", "neg"]).withColumns(
        {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)})
    return every.select(
        "threshold", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        (F.col("tp") / F.greatest(total, F.lit(1))).alias("recall"),
        F.coalesce(2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + total, F.lit(0)), F.lit(0.0)).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the greatest F1; the lowest one on a tie."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b")
    return sweep.agg(best).select("b.*")


def histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """Counts in even bins over 0–1; the top bin includes 1."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Errors of log-hour predictions: MAE and median error in hours, R² on the log scale."""
    d = df.select(F.col(actual).alias("y"), F.col(predicted).alias("p"),
                  F.abs(F.expm1(actual) - F.expm1(predicted)).alias("err"))
    sums = d.agg(
        F.count("*").alias("n"), F.avg("err").alias("mae_h"), F.sum((F.col("y") - F.col("p")) ** 2).alias("sse"),
        F.var_pop("y").alias("var"))
    median = exact_quantiles(d, [], "err", {"median_ae_h": 0.5}, 1 / 900).scalar()
    return sums.select("n", "mae_h", median.alias("median_ae_h"),
                       (1 - F.col("sse") / (F.col("var") * F.col("n"))).alias("r2_log"))
