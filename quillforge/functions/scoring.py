"""Rubric scores: sums of weighted criteria over the positive weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a judge may miss the unit interval by before its reply counts as unusable.
TOLERANCE = 0.25


def clamp(scores: Column) -> Column:
    return F.transform(scores, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rubric_score(scores: Column, weights: Column) -> Column:
    """max(0, sum(w s) / sum of positive w), 0 without positive weights; fails where the lengths differ."""
    positive = F.aggregate(F.filter(weights, lambda w: w > 0), F.lit(0.0), lambda a, w: a + w.cast("double"))
    total = F.aggregate(F.zip_with(scores, weights, lambda s, w: s * w.cast("double")), F.lit(0.0), lambda a, x: a + x)
    score = F.when(positive == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total / positive))
    return F.when(F.size(scores) != F.size(weights), F.raise_error("as many scores as weights are needed").cast("double")).otherwise(score)


def rubric_score_rows(score: Column, weight: Column) -> Column:
    """The same as an aggregate over one row a criterion."""
    positive = F.sum(F.when(weight > 0, weight).otherwise(0).cast("double"))
    return F.when(positive == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.sum(weight.cast("double") * score) / positive))


def usable_scores(reply: Column, n: Column | int) -> Column:
    """``per_criterion`` of a judge's JSON reply as clamped doubles, null where it is unusable.

    Needed: an array of exactly ``n`` numbers (numeric strings and booleans count), each within the
    tolerance of the unit interval. NaN is unusable.
    """
    n = F.lit(n) if isinstance(n, int) else n
    found = F.try_variant_get(F.try_parse_json(reply), "$.per_criterion", "array<double>")
    bad = F.exists(found, lambda x: x.isNull() | F.isnan(x) | (x < -TOLERANCE) | (x > 1 + TOLERANCE))
    return F.when(found.isNotNull() & (F.size(found) == n) & ~bad, clamp(found))


def judge_feedback(reply: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(reply), "$.feedback", "string"), F.lit(""))
