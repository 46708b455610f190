"""Text digests of rounds and sessions for the analyzer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip


def criterion_scores(rounds: DataFrame, criteria: str, samples: str, keys: list[str]) -> DataFrame:
    """A row for each criterion of each round: its number, text, weight, and the scores of all samples in order.

    A sample without that many scores gives null in its place.
    """
    rows = rounds.select(*keys, samples, F.posexplode(criteria).alias("k", "c"))
    scores = F.transform(samples, lambda s: F.try_element_at(s["per_criterion"], F.col("k") + 1))
    return rows.select(*keys, "k", F.col("c.criterion").alias("criterion"), F.col("c.weight").alias("weight"), scores.alias("scores"))


def _fixed(x: Column, form: str = "%.2f") -> Column:
    return F.format_string(form, x)


def session_round(answer_chars: int = 1500, stops: tuple[str, ...] = ("infra_error", "paper_too_long", "error")) -> Column:
    """A round of ``run_inner_loop`` as the analyzer reads it: package, verdict, scores, rubric with all scores, answers.

    Answers are clipped. A round that a technical failure ended is only marked, a malformed one shows its error.
    """
    from ..functions.text import strip

    none = F.lit("")
    score = lambda samples, k: F.coalesce(F.nullif(F.array_join(F.transform(F.col(samples), lambda s: _fixed(F.get(s["per_criterion"], k), "%.1f")), " "), none), F.lit("-"))
    line = lambda c, k: F.format_string("  [%d] %+d | weak %s | strong %s | %s", k + 1, c["weight"], score("weak_samples", k), score("strong_samples", k), c["criterion"])
    rubric = F.concat(F.lit("\nRubric (weight | weak score per answer | strong score per answer | criterion):\n"), F.array_join(F.transform("qa.criteria", line), "\n"))
    numbers = F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), _fixed(F.col(c)))) for c in ("weak_avg", "weak_max", "strong_avg", "gap")])
    why = F.coalesce(F.nullif(F.array_join("reasons", "; "), none), F.lit("all checks pass"))
    scores = F.concat(F.lit("\nScores: "), F.coalesce(F.nullif(numbers, none), F.lit("-")), F.lit("; "), why)

    def answers(label: str, samples: str) -> Column:
        cut = lambda s: F.when(s["truncated"], " (cut at the token budget)").otherwise("")
        one = lambda s, k: F.concat(F.format_string("  #%d score %.2f", k + 1, s["weighted_score"]), cut(s), F.lit(": "), clip(s["answer"], answer_chars), F.lit("\n     judge: "), F.coalesce(s["judge_feedback"], none))
        return F.when(F.size(samples) > 0, F.concat(F.lit(f"\n{label} answers:\n"), F.array_join(F.transform(samples, one), "\n"))).otherwise("")

    state = F.when(F.col("qv_verdict.passed"), "PASS").otherwise(F.concat(F.lit("FAIL ("), F.array_join("qv_verdict.issues", ", "), F.lit(")")))
    verdict = F.when(F.col("qv_verdict").isNull(), "Verifier: not reached").otherwise(F.concat(F.lit("Verifier: "), state, F.lit(". "), strip(F.coalesce("qv_verdict.feedback", none))))
    package = F.concat(
        F.lit("\nType: "), F.col("qa.question_type"), F.lit(" | tags: "), F.array_join("qa.skill_tags", ", "), F.lit("\nContext: "), F.col("qa.context"), F.lit("\nQuestion: "), F.col("qa.question"),
        F.lit("\nReference answer: "), F.col("qa.reference_answer"), F.lit("\n"), verdict, F.when(F.size("weak_samples") > 0, F.concat(scores, rubric)).otherwise(""),
        answers("Weak", "weak_samples"), answers("Strong", "strong_samples"),
    )
    number = F.col("iteration").cast("string")
    head = F.concat(F.lit("--- Round "), number, F.lit(" | "), F.col("outcome"), F.lit(" ---"))
    lost = F.concat(F.lit("--- Round "), number, F.lit(" | stopped by infrastructure (left out) ---"))
    return F.when(F.col("outcome").isin(*stops), lost).when(F.col("qa").isNull(), F.concat(head, F.lit("\n"), F.coalesce("error", none))).otherwise(F.concat(head, package))


def session_digests(rounds: DataFrame, sessions: DataFrame, answer_chars: int = 1500) -> DataFrame:
    """session_id and digest: a head line, the rounds in order, and what the final filter said.

    ``rounds`` has the columns of ``run_inner_loop`` with paper_id as the session's id; ``sessions`` has session_id, paper_id,
    title, passed, stopped_by and final_filter (struct of passed, issues and feedback, or null). Sessions without rounds have a head only.
    """
    shown = rounds.select(F.col("paper_id").alias("session_id"), F.struct("iteration", session_round(answer_chars).alias("t")).alias("r")).groupBy("session_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    state = F.when(F.col("passed"), "PASSED").when(F.col("stopped_by").isNotNull(), F.concat(F.lit("STOPPED ("), F.col("stopped_by"), F.lit(", left out)"))).otherwise("FAILED")
    head = F.concat(F.lit("paper "), F.col("paper_id"), F.lit(' "'), F.coalesce("title", F.lit("")), F.lit('" | '), state, F.lit(" ==="))
    v = F.col("final_filter")
    issues = F.when(F.size(v["issues"]) > 0, F.concat(F.lit("\n  issues: "), F.array_join(v["issues"], "; "))).otherwise("")
    last = F.when(v.isNull(), "").otherwise(F.concat(F.lit("\nFinal filter (fixed): "), F.when(v["passed"], "PASS").otherwise("FAIL"), issues, F.lit("\n  feedback: "), v["feedback"]))
    body = F.when(F.size("r") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"))).otherwise("")
    return sessions.join(shown, "session_id", "left").select("session_id", F.concat(head, body, last).alias("digest"))


def numbered(digests: list[str]) -> str:
    """The sessions of one evaluation as one text."""
    return "\n\n".join(f"=== Session {n} | {d}" for n, d in enumerate(digests, 1))


def _decimals(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 2), F.lit("-"))


def render_round(question: Column, outcome: Column, weak_avg: Column, strong_avg: Column, reasons: Column, limit: int = 1500) -> Column:
    """One round as text; a round lost to an error shows its outcome only."""
    head = F.concat(F.lit("outcome: "), outcome, F.lit("  weak_avg="), _decimals(weak_avg), F.lit("  strong_avg="), _decimals(strong_avg))
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("\nreasons: "), F.array_join(reasons, "; "))).otherwise("")
    return F.when(question.isNull(), F.concat(F.lit("outcome: "), outcome)).otherwise(F.concat(head, why, F.lit("\nquestion: "), clip(question, limit)))


def render_sessions(rounds: DataFrame, session: list[str], iteration: str, rendered: Column) -> DataFrame:
    """session columns and digest: its rounds in order, numbered."""
    line = F.concat(F.lit("## round "), F.col(iteration).cast("string"), F.lit("\n"), rendered)
    return rounds.groupBy(*session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(iteration, line.alias("t")))), lambda x: x["t"]), "\n\n").alias("digest"))
