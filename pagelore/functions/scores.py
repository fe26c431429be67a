"""Scores, confidences and classifier arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions.vectors import dot

#: Ratios of valid members from which a prototype is ok or a warning; blend of best and mean prototype score.
OK_RATIO, WARNING_RATIO, BEST_SHARE, MEAN_SHARE = 0.95, 0.85, 0.7, 0.3


def status_from_ratio(ratio: Column) -> Column:
    return F.when(ratio >= OK_RATIO, "ok").when(ratio >= WARNING_RATIO, "warning").otherwise("poor")


def normalized_score(raw: Column) -> Column:
    """A model's raw score in [0, 1]: as it is there, moved up from [-1, 0), by the logistic function elsewhere. What
    isn't a finite number is null."""
    v = raw.try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(None).cast("double")).when(v.between(0, 1), v).when((v >= -1) & (v < 0), (v + 1) / 2).otherwise(1 / (1 + F.exp(-v)))


def percent(score: Column, places: int = 4) -> Column:
    return F.round(score * 100, places)


def passes(score: Column, threshold: Column, override_pct: float | None = None) -> Column:
    """Null without a score or a threshold; an override is a percentage that replaces the threshold."""
    return score >= F.coalesce(F.lit(None if override_pct is None else override_pct / 100).cast("double"), threshold)


def blended(best: Column, mean: Column) -> Column:
    return percent(BEST_SHARE * best + MEAN_SHARE * mean)


def feature_similarity(dz: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.exp(-0.5 * dz * dz))), 2)


def family_confidence(d: Column, mean: Column, most: Column) -> Column:
    known = mean.isNotNull() & most.isNotNull() & d.isNotNull() & (mean <= most)
    return F.when(~known, "unknown").when(d <= mean, "high").when(d <= most, "medium").otherwise("low_out_of_family")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "unknown", 1).otherwise(0)


def positive(c: Column) -> Column:
    return c.isin("high", "medium")


def linear(weights: Column, x: Column, bias: Column) -> Column:
    return dot(weights, x) + bias


def softmax(logits: Column) -> Column:
    top = F.transform(F.array(logits), lambda z: F.struct(z.alias("z"), F.array_max(z).alias("m")))
    e = F.transform(top, lambda s: F.transform(s["z"], lambda x: F.exp(x - s["m"])))
    sums = F.transform(e, lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda t, x: t + x).alias("t")))
    return F.transform(sums, lambda s: F.transform(s["v"], lambda x: x / s["t"]))[0]


def defaulted(value: Column, default: Column, empty: object = 0) -> Column:
    """The default for null and ``empty`` values: 0 of numbers, which -0.0 equals, "" of texts, for which "0" is a value."""
    return F.coalesce(F.nullif(value, F.lit(empty)), default)


def encoder_hash64(token: Column) -> Column:
    """Place of a token in the deterministic 64-place encoder."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % 64
