"""Scalar column expressions: cleaning, time, flags, scores.

Everything here returns a ``Column`` so that it stays inside whole-stage
codegen and can be pushed to the scan where the source allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roadwatch import settings as S

BLANKS = " \t\r\n"


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def tidy(c) -> Column:
    """Lower-cased, trimmed text."""
    return F.lower(F.btrim(as_col(c).cast("string"), F.lit(BLANKS)))


def clean_category(c, default: str, null_words: tuple[str, ...] = ()) -> Column:
    """Trimmed lower-case category; null, blank and ``null_words`` become ``default``."""
    text = tidy(c)
    return F.coalesce(F.when(~text.isin("", *null_words), text), F.lit(default))


def spatial_category(c, default: str) -> Column:
    return clean_category(c, default, ("null",))


def parse_timestamp(c) -> Column:
    """UTC timestamp; unreadable text becomes null."""
    return as_col(c).try_cast("timestamp")


def to_number(c) -> Column:
    return as_col(c).try_cast("double")


def zero_to_null(c) -> Column:
    return F.nullif(to_number(c), F.lit(0.0))


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def truth(c, words: tuple[str, ...]) -> Column:
    """1 when the text form of the value is one of ``words``, else 0."""
    return F.coalesce(tidy(c).isin(*words), F.lit(False)).cast("int")


def is_high(c) -> Column:
    return F.coalesce(tidy(c) == "high", F.lit(False)).cast("int")


def hour_of(ts) -> Column:
    return F.coalesce(F.hour(ts), F.lit(12))


def weekday_of(ts) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def month_of(ts) -> Column:
    return F.coalesce(F.month(ts), F.lit(1))


def within(c, lo, hi) -> Column:
    return as_col(c).between(lo, hi)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def time_band(hour) -> Column:
    return (
        F.when(within(hour, 4, 7), "early_morning")
        .when(within(hour, 19, 22), "evening")
        .when(within(hour, 0, 3), "late_night")
        .otherwise("off_peak")
    )


def cause_group(cause) -> Column:
    cause = as_col(cause)
    return F.when(cause.isin(*S.CAUSE_GROUPS), cause).otherwise("other")


def is_planned(event_type, cause, has_type: bool = True) -> Column:
    if has_type:
        return F.coalesce(tidy(event_type).isin(*S.PLANNED_TYPES), F.lit(False)).cast("int")
    return F.coalesce(tidy(cause).isin(*S.PLANNED_CAUSES), F.lit(False)).cast("int")


def clip(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def proxy_impact(high, closure, planned) -> Column:
    """1–10 score from priority, closure and planned flags (half-even rounding)."""
    raw = 0.4 * high.cast("double") + 0.4 * closure.cast("double") + 0.2 * (planned.cast("double") * 0.5 + 0.5)
    return clip(F.bround(1 + 9 * raw), 1.0, 10.0).cast("int")


def composite_score(priority_p: Column, closure_p: Column, p50_h: Column, log_p95) -> Column:
    """1–10 impact score with a floor for long expected durations."""
    w = S.IMPACT_WEIGHTS
    share = clip(F.log1p(p50_h) / log_p95, 0.0, 1.0)
    base = F.bround(1 + 9 * (w["priority"] * priority_p + w["closure"] * closure_p + w["duration"] * share))
    floor = F.when(p50_h > 12, 6.0).when(p50_h > 6, 4.0).otherwise(1.0)
    return clip(F.greatest(base, floor), 1.0, 10.0).cast("int")


def hour_from_text(c) -> Column:
    """Hour taken from the first ``HH:MM`` in a text; 12 when there is none."""
    found = F.regexp_extract(F.coalesce(as_col(c).cast("string"), F.lit("")), r"(\d{2}):(\d{2})", 1)
    return F.coalesce(found.try_cast("int"), F.lit(12))


def duration_hours(start, closed, resolved) -> Column:
    end = F.coalesce(closed, resolved)
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def usable_duration(hours: Column) -> Column:
    return hours.between(0.0, S.MAX_DURATION_H)


def portable_hash(key, seed: int) -> Column:
    """Non-negative 32-bit hash of an id, the same in every SQL engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), as_col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def percent(c: Column) -> Column:
    """Whole percent as text, half-even."""
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def stable_round(c: Column, digits: int) -> Column:
    """Rounding for sums of doubles, whose last bit depends on the order of partitions.

    A nudge far below the digit shown sends exact ties to the same side every time.
    """
    return F.round(c + F.lit(1e-9), digits)


def labelled(value: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """Right-open buckets with text labels: ``cuts`` are (upper bound, label)."""
    out = None
    for bound, label in cuts:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(last)


def risk_tier(score: Column) -> Column:
    return labelled(score, [(0.33, "LOW"), (0.66, "MEDIUM")], "HIGH")


def cluster_risk(closure_rate: Column, mean_impact: Column, closed_lower: bool = False) -> Column:
    """HIGH / MEDIUM / LOW; ``closed_lower`` makes the 6 % bound inclusive."""
    medium = closure_rate >= 0.06 if closed_lower else closure_rate > 0.06
    return (
        F.when((closure_rate > 0.10) | (mean_impact >= 7), "HIGH")
        .when(medium | (mean_impact >= 5), "MEDIUM")
        .otherwise("LOW")
    )
