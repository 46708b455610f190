"""Histories of failed questions and logs of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The failure modes in the order in which a history shows them, with their headings.
HEADINGS = (
    ("too_easy", "TOO EASY (the weak solver scored too high)"),
    ("failed_on_strong", "FAILED ON STRONG (the strong solver did not clear the bar)"),
    ("failed_qv", "FAILED QV (rejected by the quality verifier)"),
    ("weak_zero", "WEAK SCORED ZERO (a weak attempt scored 0: the question may be unanswerable from the context)"),
)
TOP = "PREVIOUSLY FAILED QUESTIONS, grouped by failure mode:"


def ordered_text(rows: DataFrame, group: str, order: list[str], text, separator: str, name: str) -> DataFrame:
    """group and the texts of its rows in order, joined."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), separator).alias(name))


def render_history(attempts: DataFrame, group: str = "paper_id") -> DataFrame:
    """group and history: failed questions under their modes, each whole, in the order of seq.

    ``attempts`` has mode, seq, question and detail. A group without attempts has no row; callers take "".
    """
    rank = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, (m, _) in enumerate(HEADINGS)])
    heading = F.coalesce(*[F.when(F.col("mode") == m, F.lit(h)) for m, h in HEADINGS])
    line = F.concat(F.lit("- Q: "), F.col("question"), F.lit("\n  "), F.col("detail"))
    per = attempts.where(rank.isNotNull()).groupBy(group, rank.alias("__rank"), heading.alias("__heading")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("__lines")
    )
    block = F.concat(F.col("__heading"), F.lit(":\n"), F.col("__lines"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("__rank", block.alias("b")))), lambda x: x["b"])
    return per.groupBy(group).agg(F.concat_ws("\n\n", F.lit(TOP), blocks).alias("history"))


def last_n(log: DataFrame, group: str | None, order: list[str], n: int = 30) -> DataFrame:
    """The last n rows of each group. Ranks are cut to n before the shuffle."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def earlier_failures(attempts: DataFrame, group: str, order: str) -> DataFrame:
    """Each attempt with the questions of all earlier ones of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("earlier", F.collect_list("question").over(w))
