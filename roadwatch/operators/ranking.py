"""Order-dependent results without sorting a whole table in one task.

The common shape is two-level: a *bucket* expression that never decreases along
the requested order splits the rows; per-bucket totals (one row per bucket) give
each bucket its offset; the rest happens inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadwatch.functions.columns import portable_hash

HASH_BUCKETS = 2**16


def global_row_number(df: DataFrame, bucket: Column, order: Sequence, partition: Sequence[str] = (),
                      name: str = "row_number") -> DataFrame:
    """``row_number`` over (partition, order); ``bucket`` must not decrease along ``order``."""
    df = df.withColumn("_bucket", bucket)
    keys = [*partition, "_bucket"]
    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).count().select(
        *keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_inside", inside).join(offsets, keys)
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_inside", "_offset")
    )


def shuffled_row_number(df: DataFrame, key: str, seed: int, partition: Sequence[str] = (),
                        name: str = "row_number") -> DataFrame:
    """Random but reproducible row numbers: ordered by a portable hash of ``key``.

    Hash buckets are even by construction, so two label values do not mean two tasks.
    """
    df = df.withColumn("_h", portable_hash(key, seed))
    bucket = F.floor(F.col("_h") / F.lit(2**32 // HASH_BUCKETS)).cast("long")
    return global_row_number(df, bucket, ["_h", key], partition, name).drop("_h")


def stratified_folds(df: DataFrame, label: str, key: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """k folds with the same label share in each."""
    numbered = shuffled_row_number(df, key, seed, [label], "_rn")
    return numbered.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def kfolds(df: DataFrame, key: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", (portable_hash(key, seed) % k).cast("int"))


def running_totals(df: DataFrame, key: str, sums: dict[str, Column], by: Sequence[str] = (), buckets: int = 4096,
                   descending: bool = True) -> DataFrame:
    """Per distinct ``key`` (0 ≤ key ≤ 1): its totals and the totals up to and including it.

    Rows are first reduced to one per distinct key, so ties never form a hot group.
    Output columns: by, key, ``name`` and ``cum_name`` for each entry of ``sums``.
    """
    by = list(by)
    per_key = df.groupBy(*by, key).agg(*[c.alias(n) for n, c in sums.items()])
    sign = -1 if descending else 1
    per_key = per_key.withColumn("_bucket", sign * F.floor(F.col(key) * buckets).cast("long"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_key.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = per_bucket.select(
        *by, "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_key.withColumns({f"_in_{n}": F.sum(n).over(inside) for n in sums})
        .join(offsets, [*by, "_bucket"])
        .select(*by, key, *sums, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in sums])
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, qs: dict[str, float], width: float) -> DataFrame:
    """Interpolating quantiles per group, exact, without holding a group in one task.

    Pass 1 counts distinct values, then histogram buckets of ``width``; pass 2 looks only
    at the values of the buckets that hold the wanted ranks.
    """
    groups = list(groups)
    if not groups:
        df, groups, whole = df.withColumn("_all", F.lit(0)), ["_all"], True
    else:
        whole = False
    values = (
        df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.floor(F.col(value) / width).cast("long"))
    )
    per_group = Window.partitionBy(*groups)
    hist = values.groupBy(*groups, "_bucket").agg(F.sum("_n").alias("_c"))
    hist = hist.withColumns({
        "_before": F.coalesce(
            F.sum("_c").over(per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_c").over(per_group),
    })
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), (q * (F.col("_total") - 1)).alias("pos"))
        for name, q in qs.items() for side in ("lo", "hi")
    ]))
    rank = F.when(F.col("_w.side") == "lo", F.floor("_w.pos")).otherwise(F.ceil("_w.pos"))
    targets = (
        hist.withColumn("_w", wanted).withColumn("_rank", rank)
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        .select(*groups, "_bucket", F.col("_w.q").alias("_q"), F.col("_w.side").alias("_side"),
                (F.col("_w.pos") - F.floor("_w.pos")).alias("_frac"),
                (F.col("_rank") - F.col("_before")).alias("_at"))
    )
    needed = values.join(targets.select(*groups, "_bucket").distinct(), [*groups, "_bucket"], "left_semi")
    upto = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        needed.withColumn("_upto", F.sum("_n").over(upto)).join(targets, [*groups, "_bucket"])
        .filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    )

    def at(name, side):
        return F.max(F.when((F.col("_q") == name) & (F.col("_side") == side), F.col(value)))

    def interpolate(name):
        frac = F.max(F.when(F.col("_q") == name, F.col("_frac")))
        return at(name, "lo") + (at(name, "hi") - at(name, "lo")) * frac

    out = found.groupBy(*groups).agg(*[interpolate(name).alias(name) for name in qs])
    return out.drop("_all") if whole else out


def top_value(counts: DataFrame, groups: Sequence[str], value: str, n: str, name: str) -> DataFrame:
    """Most frequent value per group from a (group, value, n) table; ties go to the smallest value."""
    return counts.groupBy(*groups).agg(F.min_by(value, F.struct(-F.col(n), F.col(value))).alias(name))


def count_bucket(key: str) -> Column:
    """Monotone bucket for counts: a few thousand logarithmic ranges, negatives in front."""
    x = F.col(key)
    return F.when(x < 0, -1).otherwise(F.floor(F.log1p(F.greatest(x, F.lit(0.0))) * 64)).cast("long")


def as_of(values: DataFrame, steps: DataFrame, key: str, payload: str, bucket: Column) -> DataFrame:
    """For each value the payload of the last step strictly below it.

    Buckets carry the last step of earlier buckets forward, so neither side is
    sorted in one task.
    """
    both = (
        values.select(F.col(key), F.lit(0).alias("_step"), F.lit(None).cast(steps.schema[payload].dataType).alias(payload))
        .unionByName(steps.select(F.col(key), F.lit(1).alias("_step"), payload))
        .withColumn("_bucket", bucket)
    )
    last = F.last(payload, ignorenulls=True)
    in_bucket = Window.partitionBy("_bucket").orderBy(key, "_step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("_bucket").agg(F.max_by(payload, F.when(F.col("_step") == 1, F.col(key))).alias("_top"))
    carried = tops.select("_bucket", F.last("_top", ignorenulls=True).over(before).alias("_carried"))
    return (
        both.withColumn("_found", last.over(in_bucket)).filter(F.col("_step") == 0).join(carried, "_bucket")
        .select(key, F.coalesce("_found", "_carried").alias(payload))
    )
