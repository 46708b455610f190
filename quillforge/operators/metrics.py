"""Metrics over samples, questions, sessions and model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_k(samples: DataFrame, question: str, score: str, infra: str, truncated: str) -> DataFrame:
    """One row: n, left_out, mean_at_k, best_at_k, truncation_rate.

    Questions with a technical failure are left out of everything but ``left_out``; without a complete
    question the metrics are null, not 0.
    """
    per = samples.groupBy(question).agg(
        F.count_if(F.col(infra)).alias("failed"), F.avg(score).alias("mean"), F.max(score).alias("best"),
        F.count_if(F.col(truncated)).alias("cut"), F.count(F.lit(1)).alias("k"),
    )
    whole = lambda c: F.when(F.col("failed") == 0, F.col(c))
    return per.agg(
        F.count_if(F.col("failed") == 0).alias("n"), F.count_if(F.col("failed") > 0).alias("left_out"), F.avg(whole("mean")).alias("mean_at_k"),
        F.avg(whole("best")).alias("best_at_k"), F.try_divide(F.sum(whole("cut")), F.sum(whole("k"))).alias("truncation_rate"),
    )


def plain_averages(samples: DataFrame, question: str, solver: str, score: str) -> DataFrame:
    """Mean score by question and solver with technical failures counted as 0, as the one-off grading tool reports it."""
    return samples.groupBy(question, solver).agg(F.avg(F.coalesce(F.col(score), F.lit(0.0))).alias("avg_score"))


def session_scores(sessions: DataFrame, group: str, passed: Column, scored: Column, least_share: float = 0.8) -> DataFrame:
    """group, total, scored, passed, score (null where none was scored), valid."""
    counts = sessions.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(scored).alias("scored"), F.count_if(passed & scored).alias("passed"))
    return counts.select(
        "*", F.try_divide(F.col("passed").cast("double"), F.col("scored")).alias("score"),
        ((F.col("scored") > 0) & (F.col("scored") >= F.lit(least_share) * F.col("total"))).alias("valid"),
    )


def usage_totals(calls: DataFrame, order: str) -> DataFrame:
    """Calls, missing usage, latency and tokens by role; the model is the first seen. Partial sums merge, so logs of several processes may be one table."""
    tokens = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "cached_tokens")
    return calls.groupBy("role").agg(
        F.min_by("model", order).alias("model"), F.count(F.lit(1)).alias("calls"), F.count_if("usage_missing").alias("usage_missing"),
        F.sum("latency_s").alias("latency_s"), *[F.sum(F.coalesce(F.col(t), F.lit(0))).cast("long").alias(t) for t in tokens],
    )


def run_summary(rounds: DataFrame, done: DataFrame) -> DataFrame:
    """One row over a run: papers done, accepted, final and their yields, rounds, truncation rates.

    ``rounds`` has outcome, weak_n, weak_cut, strong_n, strong_cut (a crash row has none and is no round); ``done``
    has paper_id, accepted, final. Rates of nothing are 0, and technical failures count here.
    """
    rate = lambda part, whole: F.coalesce(F.sum(part), F.lit(0)) / F.greatest(F.coalesce(F.sum(whole), F.lit(0)), F.lit(1))
    a = rounds.where(F.col("outcome").isNotNull()).agg(
        F.count(F.lit(1)).alias("rounds"), rate("weak_cut", "weak_n").alias("weak_truncation_rate"), rate("strong_cut", "strong_n").alias("strong_truncation_rate"),
    )
    share = lambda c: F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    b = done.agg(F.count(F.lit(1)).alias("papers"), F.count_if("accepted").alias("accepted"), F.count_if("final").alias("final"), share(F.col("accepted")).alias("accept_yield"), share(F.col("final")).alias("final_yield"))
    return b.crossJoin(a)  # one row each


def outcome_counts(rounds: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rounds.where(F.col(outcome).isNotNull()).groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def running_mean(scores: DataFrame, group: str, order: list[str], score: str) -> DataFrame:
    """Each score with the mean of its group so far, itself included: a parent's mean after its latest evaluation."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scores.withColumn("mean_so_far", F.avg(score).over(w))


def accepts(child: Column, parent_scores: Column) -> Column:
    """A child is taken only when it is strictly above its parent's mean, the newest score included."""
    mean = F.try_divide(F.aggregate(parent_scores, F.lit(0.0), lambda a, x: a + x), F.size(parent_scores))
    return F.coalesce(child > mean, F.lit(False))
