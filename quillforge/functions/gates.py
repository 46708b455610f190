"""The two-stage acceptance gate and the outcome of a round, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the gate; scores are compared as raw doubles."""

    weak_avg_max: float = 0.65
    weak_max_max: float = 0.75
    no_zeros: bool = True
    strong_avg_min: float = 0.60
    strong_avg_max: float = 0.95  # exclusive
    gap_min: float = 0.20


#: Outcomes that end a paper's loop, and those that go into its history.
STOP_OUTCOMES = ("infra_error", "paper_too_long", "error")
FAILURE_MODES = ("too_easy", "failed_on_strong", "failed_qv", "weak_zero")


def mean(scores: Column) -> Column:
    """The mean of an array, null when it is empty."""
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))


def weak_check(avg: Column, top: Column, zeros: Column, t: Thresholds = Thresholds()) -> Column:
    """struct(too_easy, has_zero, reasons, passed) from a question's mean, maximum and number of zero scores.

    A null mean (no scores) fails with a reason of its own.
    """
    too_easy = (avg > t.weak_avg_max) | (top > t.weak_max_max)
    zero = F.lit(t.no_zeros) & (zeros > 0)
    reasons = F.when(avg.isNull(), F.array(F.lit("no weak scores"))).otherwise(F.array_compact(F.array(
        F.when(avg > t.weak_avg_max, "weak_avg"), F.when(top > t.weak_max_max, "weak_max"), F.when(zero, "weak_zero"),
    )))
    fine = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(fine(too_easy).alias("too_easy"), fine(zero).alias("has_zero"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def strong_check(weak_avg: Column, strong_avg: Column, t: Thresholds = Thresholds()) -> Column:
    """struct(gap, reasons, passed); all three rules are tried."""
    gap = strong_avg - weak_avg
    reasons = F.when(strong_avg.isNull(), F.array(F.lit("no strong scores"))).otherwise(F.array_compact(F.array(
        F.when(strong_avg < t.strong_avg_min, "strong_avg_low"), F.when(strong_avg >= t.strong_avg_max, "saturated"), F.when(gap < t.gap_min, "gap"),
    )))
    return F.struct(gap.alias("gap"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def gate_outcome(weak_avg: Column, weak_max: Column, weak_zeros: Column, strong_avg: Column, t: Thresholds = Thresholds()) -> Column:
    """``no_weak``, ``too_easy``, ``weak_zero``, ``failed_on_strong`` or ``accepted``, tried in this order."""
    weak, strong = weak_check(weak_avg, weak_max, weak_zeros, t), strong_check(weak_avg, strong_avg, t)
    return (
        F.when(weak_avg.isNull(), "no_weak").when(weak["too_easy"], "too_easy").when(weak["has_zero"], "weak_zero")
        .when(~strong["passed"], "failed_on_strong").otherwise("accepted")
    )


def round_outcome(
    too_long: Column, malformed: Column, error: Column, verdict_unusable: Column, verdict_passed: Column,
    weak_infra: Column, strong_infra: Column, gate: Column,
) -> Column:
    """The outcome of a whole round; the first that applies wins, as later steps then never ran."""
    return (
        F.when(too_long, "paper_too_long").when(malformed, "malformed").when(error, "error").when(verdict_unusable, "infra_error")
        .when(~verdict_passed, "failed_qv").when(weak_infra, "infra_error").when(gate.isin("too_easy", "weak_zero"), gate)
        .when(strong_infra, "infra_error").otherwise(gate)
    )


def stops(outcomes: Column) -> Column:
    """The outcome that stopped a paper: its last one where that is a stop outcome, else null."""
    last = F.when(F.size(outcomes) > 0, F.element_at(outcomes, -1))
    return F.when(last.isin(*STOP_OUTCOMES), last)


def first_infra_error(samples: Column) -> Column:
    """The feedback of the first sample that failed for technical reasons, null without one."""
    failed = F.filter(samples, lambda s: s["infra_error"])
    return F.when(F.size(failed) > 0, failed[0]["judge_feedback"])


def to_rerun(samples: Column) -> Column:
    """Indexes of the samples whose answer must be bought again; a judge's failure isn't such a one."""
    index = F.transform(samples, lambda s, i: F.when(s["infra_error"] & F.coalesce(s["judge_feedback"], F.lit("")).startswith("solver_error"), i))
    return F.array_compact(index)


def truncation_note(samples: Column, solver: str) -> Column:
    cut = F.size(F.filter(samples, lambda s: s["truncated"]))
    note = F.concat(F.lit("; "), cut.cast("string"), F.lit("/"), F.size(samples).cast("string"), F.lit(f" {solver} attempts hit the token budget"))
    return F.when(cut > 0, note).otherwise("")


def first_best(samples: Column, ascending: bool = False) -> Column:
    """The sample with the best score (the worst, if ascending); the first of equal ones."""
    score = F.transform(samples, lambda s: s["weighted_score"])
    top = F.array_min(score) if ascending else F.array_max(score)
    return F.when(F.size(samples) > 0, F.element_at(samples, F.array_position(score, top).cast("int")))
