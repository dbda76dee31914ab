"""Smoothed target encoding of a categorical column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadwatch import settings as S
from roadwatch.operators.lookup import look_up


def blend(n: Column, mean: Column, prior: Column) -> Column:
    """Weight of the category mean grows with its row count along a sigmoid."""
    weight = 1 / (1 + F.exp(-(n - S.ENCODING_MIN_LEAF) / F.lit(S.ENCODING_SMOOTHING)))
    return prior + (mean - prior) * weight


def fit_target_encoding(df: DataFrame, column: str, target: str, prior: Column | None = None) -> DataFrame:
    """(category, n, encoding) from one partially aggregated shuffle.

    Totals per category are kept for the prior, so it costs no second scan.
    """
    cells = df.groupBy(column).agg(F.count("*").alias("n"), F.sum(target).alias("_s"))
    if prior is None:
        cells = cells.persist()
        prior = cells.agg(F.sum("_s") / F.sum("n")).scalar()
    return cells.withColumn("encoding", blend(F.col("n"), F.col("_s") / F.col("n"), prior)).drop("_s")


def apply_target_encoding(df: DataFrame, encoding: DataFrame, column: str, prior: Column, name: str) -> DataFrame:
    """Unseen categories get the prior."""
    lookup = encoding.select(column, F.col("encoding").alias(name))
    return look_up(df, lookup, [column]).withColumn(name, F.coalesce(F.col(name), prior))


def fold_encodings(df: DataFrame, column: str, target: str, name: str, k: int = S.N_FOLDS, fold: str = "fold") -> DataFrame:
    """(category, fold, encoding): for each held-out fold, the encoder of all other folds.

    All folds come from one pass: totals per (category, fold) are subtracted from
    totals per category, so the encoder is never refitted fold by fold.
    """
    cells = df.groupBy(column, fold).agg(F.count("*").alias("_n"), F.sum(target).alias("_s")).persist()
    by_cat = cells.groupBy(column).agg(F.sum("_n").alias("_cn"), F.sum("_s").alias("_cs"))
    by_fold = cells.groupBy(fold).agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    total = cells.agg(F.struct(F.sum("_n").alias("n"), F.sum("_s").alias("s"))).scalar()
    prior = (total["s"] - F.col("_fs")) / (total["n"] - F.col("_fn"))
    n = F.col("_cn") - F.coalesce("_n", F.lit(0))
    mean = (F.col("_cs") - F.coalesce("_s", F.lit(0))) / F.nullif(n, F.lit(0))
    grid = by_cat.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.join(by_fold, fold).join(cells, [column, fold], "left").select(
        column, fold, F.coalesce(blend(n, mean, prior), prior).alias(name))


def out_of_fold_encoding(df: DataFrame, column: str, target: str, name: str, k: int = S.N_FOLDS, fold: str = "fold") -> DataFrame:
    """Each row encoded from the rows of the other folds."""
    return look_up(df, fold_encodings(df, column, target, name, k, fold), [column, fold], "inner")
