"""The bounded loop generate, verify, answer, judge, over all papers at once.

Every step is a table that is written before the next step reads it, so a later, dearer step only sees
the rows that the earlier one let pass, and finished steps are never asked again when an executor is
lost (a task that was under way is). A round's ``active`` papers shrink by the papers that were accepted
or stopped. All texts that models see come from one ``PromptSet``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints
from ..functions import gates, json_text, scoring, text, verdict
from ..operators.calls import Models, Reply, ask, stable_number
from ..operators.history import render_history
from ..sources.schemas import CRITERION
from .prompts import PLAIN, PromptSet


@dataclass(frozen=True)
class LoopConfig:
    max_iterations: int = 15
    samples: int = 3
    infra_retries: int = 2
    thresholds: gates.Thresholds = field(default_factory=gates.Thresholds)


@dataclass(frozen=True)
class Shape:
    """Counts of criteria that the final filter asks for."""

    least_positive: int = 4
    least_negative: int = 3
    least_total: int = 10
    most_total: int = 20


#: Gets each written table of replies and its role, e.g. to log their usage.
Meter = Callable[[DataFrame, str], None]


@dataclass(frozen=True)
class ScriptedModels:
    """Offline models whose replies are a function of role, prompt and attempt."""

    def reply(self, role: str, system: str, user: str, attempt: int) -> Reply:
        n = stable_number(role, user, str(attempt))
        if role == "challenger":
            if n % 11 == 0:
                return Reply("no JSON today")
            criteria = [{"criterion": f"point {i}", "weight": 2 if i < 6 else -2, "category": "positive" if i < 6 else "negative"} for i in range(10)]
            qa = {"question_type": "why", "skill_tags": [], "context": "c", "question": f"Q{n % 10_000}?", "reference_answer": "r", "rubric": criteria}
            return Reply(f"```json\n{json.dumps(qa)}\n```")
        if role == "quality_verifier":
            good = "GOOD" if n % 5 else "BAD"
            return Reply(json.dumps({**verdict.PASSING, "check_2_verdict": good, "overall": "PASS" if n % 5 else "FAIL", "feedback": "seen"}))
        if role == "judge":
            strong = "strong" in user
            share = (n % 40 + (60 if strong else 10)) / 100
            return Reply(json.dumps({"per_criterion": [min(1.0, share)] * 6 + [0] * 4, "feedback": "graded"}))
        return Reply(f"{'strong' if 'strong' in role else 'weak'} answer {n % 1000}")


_QA = f"struct<question_type:string,skill_tags:array<string>,context:string,question:string,reference_answer:string,criteria:array<{CRITERION}>>"


def parse_question(replied: DataFrame) -> DataFrame:
    """``replied`` with qa (null where malformed), too_long, call_error and problem."""
    r = F.col("reply")
    value = F.try_parse_json(json_text.extract_json(r["text"]))
    need = ("question_type", "context", "question", "reference_answer")
    get = lambda k, t="string": F.try_variant_get(value, f"$.{k}", t)
    criteria = get("rubric", f"array<{CRITERION}>")
    whole = F.lit(True)
    for k in need:
        whole &= get(k).isNotNull()
    tags = F.coalesce(get("skill_tags", "array<string>"), F.expr("cast(array() as array<string>)"))
    qa = F.struct(get("question_type").alias("question_type"), tags.alias("skill_tags"), *[get(k).alias(k) for k in need[1:]], criteria.alias("criteria"))
    fine = r["error_class"].isNull() & ~r["truncated"] & value.isNotNull() & whole & verdict.rubric_valid(criteria)
    problem = (
        F.when(r["truncated"], "the reply was cut off").when(value.isNull(), "no JSON").when(~whole, "a key is missing")
        .when(~verdict.rubric_valid(criteria), "the rubric is invalid")
    )
    return replied.withColumn("qa", F.when(fine, qa)).withColumn("too_long", F.coalesce(r["error_class"] == "context_length", F.lit(False))).withColumn(
        "call_error", F.when(r["error_class"].isNotNull() & (r["error_class"] != "context_length"), r["error"])
    ).withColumn("problem", F.when(r["error_class"].isNull(), problem))


def _rubric_json(criteria):
    return json_text.prompt_json(criteria)


def grade(questions: DataFrame, models: Models, solver: str, cfg: LoopConfig, saved: Checkpoints, name: str, prompts: PromptSet = PLAIN, meter: Meter | None = None) -> DataFrame:
    """paper_id and samples (in order) of a solver; only answers that failed are bought again.

    A cut-off empty answer scores 0 and isn't judged; another empty one, or a failed call, is a
    technical failure, as is a judge's reply that stays unusable.
    """
    base = questions.select("paper_id", F.col("qa.context").alias("context"), F.col("qa.question").alias("question"), F.col("qa.criteria").alias("criteria"))
    todo = base.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(cfg.samples - 1)))).withColumn("prompt", prompts.column("solver_user", context=F.col("context"), question=F.col("question")))
    answered = None
    for k in range(cfg.infra_retries + 1):
        got = saved.save(ask(todo.withColumn("__try", F.col("sample") + F.lit(1000 * k)), models, solver, prompts.texts["solver_system"], "prompt", "__try").drop("__try"), f"{name}-{solver}-{k}")
        if meter:
            meter(got, solver)
        r = F.col("reply")
        blank = text.is_blank(r["text"]) & r["error_class"].isNull()
        got = got.withColumn("failed", r["error_class"].isNotNull() | (blank & ~F.coalesce(r["truncated"], F.lit(False))))
        last = k == cfg.infra_retries
        done = got if last else got.where(~F.col("failed"))
        answered = done if answered is None else answered.unionByName(done)
        if last:
            break
        todo = got.where("failed").drop("reply", "failed")
        if todo.first() is None:
            break
    judged = answered.where(~F.col("failed") & ~text.is_blank(F.col("reply.text"))).withColumn("answer", F.col("reply.text")).withColumn("cut", F.col("reply.truncated")).drop("reply")
    pending = judged.withColumn("prompt", prompts.column("judge_user", context=F.col("context"), question=F.col("question"), candidate_answer=F.col("answer"), rubric_json=_rubric_json(F.col("criteria"))))
    graded = None
    for k in range(cfg.infra_retries + 1):
        got = saved.save(ask(pending.withColumn("__try", F.lit(k)), models, "judge", prompts.texts["judge_system"], "prompt", "__try").drop("__try"), f"{name}-{solver}-judge-{k}")
        if meter:
            meter(got, "judge")
        found = json_text.extract_json(F.col("reply.text"))
        got = got.withColumn("__json", found)
        got = got.withColumn("scores", scoring.usable_scores(F.col("__json"), F.size("criteria"))).withColumn("feedback", scoring.judge_feedback(F.col("__json"))).drop("__json")
        again = F.col("scores").isNull() & F.col("reply.error_class").isNull() & ~F.coalesce(F.col("reply.truncated"), F.lit(False))
        last = k == cfg.infra_retries
        done = got if last else got.where(~again)
        graded = done if graded is None else graded.unionByName(done)
        if last:
            break
        pending = got.where(again).drop("reply", "scores", "feedback")
        if pending.first() is None:
            break
    weights = F.transform("criteria", lambda c: c["weight"])
    scored = graded.select(
        "paper_id", "sample", "answer", F.col("scores").alias("per_criterion"),
        F.when(F.col("scores").isNotNull(), scoring.rubric_score(F.col("scores"), weights)).otherwise(0.0).alias("weighted_score"),
        F.when(F.col("scores").isNull(), "PARSE_FAIL").otherwise(F.col("feedback")).alias("judge_feedback"), F.col("scores").isNull().alias("infra_error"), F.col("cut").alias("truncated"),
    )
    empty = answered.where(F.col("failed") | text.is_blank(F.col("reply.text"))).select(
        "paper_id", "sample", F.lit("").alias("answer"), F.expr("cast(array() as array<double>)").alias("per_criterion"), F.lit(0.0).alias("weighted_score"),
        F.when(F.col("failed"), F.concat(F.lit("solver_error: "), F.coalesce("reply.error", F.lit("empty answer")))).otherwise("no answer within the token budget").alias("judge_feedback"),
        F.col("failed").alias("infra_error"), F.coalesce("reply.truncated", F.lit(False)).alias("truncated"),
    )
    sample = F.struct("sample", "answer", "per_criterion", "weighted_score", "judge_feedback", "infra_error", "truncated")
    return saved.save(scored.unionByName(empty).groupBy("paper_id").agg(F.array_sort(F.collect_list(sample)).alias("samples")), f"{name}-{solver}-samples")


def _scores(samples):
    return F.transform(samples, lambda s: s["weighted_score"])


def verifier_prompt(prompts: PromptSet):
    """The verifier's message from title, text and qa; it never holds the reference answer."""
    q = {k: F.col(f"qa.{k}") for k in ("question_type", "context", "question")}
    return prompts.column("qv_user", paper_title=F.col("title"), paper_text=F.col("text"), **q, rubric_json=_rubric_json(F.col("qa.criteria")))


def _fixed(x, places: int = 2):
    return F.format_string(f"%.{places}f", x)


def failure_detail(outcome):
    """What a later round is told about a failed question: its scores or issues, and what the judge or verifier said.

    Needs v, weak_avg, weak_max, weak_samples, strong_avg, strong_samples, gap and reasons.
    """
    best, worst = gates.first_best(F.col("weak_samples")), gates.first_best(F.col("strong_samples"), ascending=True)
    said = lambda sample: F.concat(F.lit("; judge: "), F.coalesce(text.snippet(sample["judge_feedback"]), F.lit("")))
    weak = F.concat(F.lit("weak_avg="), _fixed(F.col("weak_avg")), F.lit(" weak_max="), _fixed(F.col("weak_max")), gates.truncation_note(F.col("weak_samples"), "weak"), said(best))
    strong = F.concat(
        F.lit("strong_avg="), _fixed(F.col("strong_avg")), F.lit(" weak_avg="), _fixed(F.col("weak_avg")), F.lit(" gap="), _fixed(F.col("gap")), F.lit(" ("), F.array_join("reasons", "; "), F.lit(")"),
        gates.truncation_note(F.col("strong_samples"), "strong"), said(worst),
    )
    verified = F.concat(F.lit("issues: "), F.array_join("v.issues", ", "), F.lit("; verifier: "), F.coalesce(text.snippet(F.col("v.feedback")), F.lit("")))
    return F.when(outcome == "failed_qv", verified).when(outcome == "failed_on_strong", strong).when(outcome.isin("too_easy", "weak_zero"), weak)


def run_inner_loop(papers: DataFrame, models: Models, cfg: LoopConfig = LoopConfig(), prompts: PromptSet = PLAIN, meter: Meter | None = None) -> DataFrame:
    """One row a paper and round: paper_id, iteration, outcome, qa, qv_verdict, weak_samples, strong_samples, weak_avg, weak_max, strong_avg, gap, reasons, accepted, error.

    ``papers`` has paper_id (unique), title and text, and may have shown_id, the id that models see. A paper's loop ends when a question is accepted,
    when an outcome stops it, or after ``max_iterations``. A malformed reply burns a round and leaves a
    note for the next one only; technical failures never enter the history.
    """
    saved = Checkpoints(papers.sparkSession)
    shown_id = F.col("shown_id") if "shown_id" in papers.columns else F.col("paper_id")
    papers = saved.save(papers.select("paper_id", shown_id.alias("shown_id"), "title", "text"), "papers")
    active = papers.select("paper_id", F.lit("").alias("note"))
    rounds = attempts = None
    for it in range(cfg.max_iterations):
        name = f"round-{it}"
        shown = render_history(attempts) if attempts is not None else None
        open_ = active.join(papers, "paper_id")
        open_ = open_.join(shown, "paper_id", "left") if shown is not None else open_.withColumn("history", F.lit(None).cast("string"))
        feedback = F.concat_ws("\n\n", F.nullif("note", F.lit("")), "history")
        asked = ask(open_.select("paper_id", prompts.challenger(F.col("title"), F.col("shown_id"), F.col("text"), feedback).alias("prompt")), models, "challenger", prompts.texts["challenger_system"], "prompt")
        replied = saved.save(asked.drop("prompt"), f"{name}-challenger")
        if meter:
            meter(replied, "challenger")
        made = saved.save(parse_question(replied).drop("reply"), f"{name}-questions")
        # The verifier never sees the reference answer.
        to_verify = made.where(F.col("qa").isNotNull()).join(papers, "paper_id").select(
            "paper_id", verifier_prompt(prompts).alias("prompt")
        )
        verdicts = None
        for k in range(cfg.infra_retries + 1):
            got = saved.save(ask(to_verify.withColumn("__try", F.lit(k)), models, "quality_verifier", prompts.texts["qv_system"], "prompt", "__try").drop("__try"), f"{name}-verifier-{k}")
            if meter:
                meter(got, "quality_verifier")
            got = got.withColumn("v", verdict.verdict(json_text.extract_json(F.col("reply.text"))))
            again = F.col("v").isNull() & F.col("reply.error_class").isNull() & ~F.coalesce(F.col("reply.truncated"), F.lit(False))
            last = k == cfg.infra_retries
            done = got if last else got.where(~again)
            verdicts = done if verdicts is None else verdicts.unionByName(done)
            if last:
                break
            to_verify = got.where(again).select("paper_id", "prompt")
            if to_verify.first() is None:
                break
        verdicts = saved.save(verdicts.select("paper_id", "v", (F.coalesce(F.col("reply.error_class") == "context_length", F.lit(False))).alias("v_too_long")), f"{name}-verdicts")
        passed = made.join(verdicts.where("v.passed").select("paper_id"), "paper_id", "left_semi")
        weak = grade(passed, models, "weak_solver", cfg, saved, name, prompts, meter)
        weak = weak.select(
            "paper_id", F.col("samples").alias("weak_samples"), gates.first_infra_error(F.col("samples")).alias("weak_infra"), gates.mean(_scores("samples")).alias("weak_avg"),
            F.array_max(_scores("samples")).alias("weak_max"), F.size(F.filter(_scores("samples"), lambda x: x == 0)).alias("weak_zeros"),
        )
        check = gates.weak_check(F.col("weak_avg"), F.col("weak_max"), F.col("weak_zeros"), cfg.thresholds)
        to_strong = passed.join(weak.where(F.col("weak_infra").isNull() & check["passed"]).select("paper_id"), "paper_id", "left_semi")
        strong = grade(to_strong, models, "strong_solver", cfg, saved, name, prompts, meter)
        strong = strong.select("paper_id", F.col("samples").alias("strong_samples"), gates.first_infra_error(F.col("samples")).alias("strong_infra"), gates.mean(_scores("samples")).alias("strong_avg"))
        all_ = made.join(verdicts, "paper_id", "left").join(weak, "paper_id", "left").join(strong, "paper_id", "left")
        gate = gates.gate_outcome(F.col("weak_avg"), F.col("weak_max"), F.col("weak_zeros"), F.col("strong_avg"), cfg.thresholds)
        no = lambda c: F.coalesce(c, F.lit(False))
        outcome = gates.round_outcome(
            F.col("too_long") | no(F.col("v_too_long")), F.col("problem").isNotNull(), F.col("call_error").isNotNull(), F.col("v").isNull(), no(F.col("v.passed")),
            F.col("weak_infra").isNotNull(), F.col("strong_infra").isNotNull(), gate,
        )
        reasons = F.when(F.col("strong_avg").isNotNull(), gates.strong_check(F.col("weak_avg"), F.col("strong_avg"), cfg.thresholds)["reasons"]).when(F.col("weak_avg").isNotNull(), check["reasons"]).otherwise(F.col("v.issues"))
        ended = all_.withColumn("outcome", outcome).withColumn("gap", F.col("strong_avg") - F.col("weak_avg")).withColumn("reasons", reasons)
        this = saved.save(ended.select(
            "paper_id", F.lit(it).alias("iteration"), "outcome", "qa", F.col("v").alias("qv_verdict"), "weak_samples", "strong_samples", "weak_avg", "weak_max", "strong_avg", "gap",
            "reasons", (F.col("outcome") == "accepted").alias("accepted"), F.coalesce("problem", "call_error", "weak_infra", "strong_infra").alias("error"), failure_detail(F.col("outcome")).alias("detail"),
        ), name)
        rounds = this if rounds is None else rounds.unionByName(this)
        failed = this.where(F.col("outcome").isin(*gates.FAILURE_MODES)).select(
            "paper_id", F.col("outcome").alias("mode"), F.col("iteration").alias("seq"), F.col("qa.question").alias("question"), F.coalesce("detail", F.lit("")).alias("detail"),
        )
        attempts = failed if attempts is None else attempts.unionByName(failed)
        note = F.when(F.col("outcome") == "malformed", F.concat(F.lit("[Your previous response was malformed] "), F.col("error"), F.lit("\nReply only with one valid JSON object."))).otherwise("")
        active = this.where(~F.col("outcome").isin("accepted", *gates.STOP_OUTCOMES)).select("paper_id", note.alias("note"))
        if active.first() is None:
            break
    return rounds


def final_filter(
    accepted: DataFrame, papers: DataFrame, models: Models, outage_fails: bool = True, prompts: PromptSet = PLAIN, shape: Shape = Shape(), retries: int = 2, meter: Meter | None = None
) -> DataFrame:
    """paper_id, passed, issues and feedback: the rubric's shape first, and the verifier only for those whose shape is right.

    ``prompts`` are the seed's, whatever variant made the question. An unreadable reply is asked for again,
    ``retries`` times, and then fails. A call that failed altogether fails too, or is null where
    ``outage_fails`` is off (then the session leaves the score).
    """
    saved = Checkpoints(accepted.sparkSession)
    n = verdict.rubric_counts(F.col("qa.criteria"))
    wrong = verdict.rubric_shape(n["n_positive"], n["n_total"], shape.least_positive, shape.least_negative, shape.least_total, shape.most_total)
    shaped = saved.save(accepted.select("paper_id", "qa", wrong.alias("wrong")), "shape")
    pending = shaped.where(F.size("wrong") == 0).join(papers, "paper_id").select("paper_id", verifier_prompt(prompts).alias("prompt"))
    judged = None
    for k in range(retries + 1):
        got = saved.save(ask(pending.withColumn("__try", F.lit(k)), models, "quality_verifier", prompts.texts["qv_system"], "prompt", "__try").drop("__try"), f"verdicts-{k}")
        if meter:
            meter(got, "quality_verifier")
        got = got.withColumn("v", verdict.verdict(json_text.extract_json(F.col("reply.text"))))
        again = F.col("v").isNull() & F.col("reply.error_class").isNull()
        done = got if k == retries else got.where(~again)
        judged = done if judged is None else judged.unionByName(done)
        if k == retries:
            break
        pending = got.where(again).select("paper_id", "prompt")
        if pending.first() is None:
            break
    ok = F.when(F.col("reply.error_class").isNotNull(), F.lit(False) if outage_fails else F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("v.passed"), F.lit(False)))
    said = judged.select("paper_id", ok.alias("passed"), F.coalesce("v.issues", F.expr("cast(array() as array<string>)")).alias("issues"), F.coalesce("v.feedback", "reply.error", F.lit("")).alias("feedback"))
    off = shaped.where(F.size("wrong") > 0).select("paper_id", F.lit(False).alias("passed"), F.transform("wrong", lambda x: F.concat(F.lit("rubric_count_"), x)).alias("issues"), F.lit("").alias("feedback"))
    return saved.save(off.unionByName(said), "filtered")
